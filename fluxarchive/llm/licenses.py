"""Licence scans by a trained paragraph classifier (native: DataFrame functions and the JVM's feature and model stages).

A sparse multinomial logistic regression over word uni- and bigrams of the templates names the licence family of each
paragraph. A paragraph is a line; lines that were only wrapped are joined first, so that notices wrapped at a column are
whole. The unknown class is taught by prose and by decoys, and calibrated on notices and decoys that training does not
see: a family counts only from the confidence at which those decoys fail and those notices pass. A comparison with the
family's templates, by containment of their bigrams, confirms the prediction.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Usual notices of each family, as their authors recommend them, and their identifiers.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.", "GNU AGPL v3", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "Apache-2.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
        "Boost Software License 1.0", "BSL-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "Creative Commons BY-SA 4.0", "Creative Commons BY-NC-SA 3.0", "Creative Commons Attribution License", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.", "Released into the public domain under CC0 1.0.", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "CC0-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Licensed under the Eclipse Public License, version 2.0.", "Eclipse Public License v1.0", "EPL-2.0", "EPL-1.0",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.", "This work is licensed under the GNU General Public License, version 2.",
        "Distributed under GNU GPL v3.", "GNU GPL v2", "Licensed under the GPL version 3", "GPLv2", "GPLv3", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.", "Licensed under the ISC license.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LGPL v2.1", "LGPLv2.1", "LGPLv3", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is licensed under the terms of the MIT license.", "Released under the MIT License.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License 1.1", "MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Released under the zlib license.", "Licensed under the zlib/libpng license",
    ),
}
# Notices of the families in other words or of other versions; they set the threshold and are not trained on.
HELD_OUT = {
    "agpl": ("This file is part of the server, which is free software under the terms of the GNU Affero General Public License, version 3 or later.",),
    "apache": ("The code is made available under the Apache License, Version 2.0; see LICENSE for its text.", "You may not use this file except in compliance with the License, a copy of which you may obtain at the address below."),
    "boost": ("Use, modification and distribution are subject to the Boost Software License, Version 1.0.",),
    "bsd": ("Use of this code is governed by the BSD-style license that can be found in the file named LICENSE.", "The source is released under the BSD 3-Clause License as well."),
    "cc": ("All photographs are licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Text: CC BY-SA 4.0, pictures as marked.", "(c) 2019 the authors, CC BY-NC 4.0"),
    "cc0": ("The data set is in the public domain under CC0 1.0.",),
    "epl": ("All rights are granted under the terms of the Eclipse Public License v2.0.",),
    "gpl": ("The tool is distributed under GNU GPL v3 or any later version.", "It may be redistributed and/or modified under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    "isc": ("The package is released under the ISC License, like its parts.",),
    "lgpl": ("The library is licensed under the GNU Lesser General Public License, version 2.1 or later.",),
    "mit": ("This module is licensed under the MIT license.", "Copies of the Software must include the above copyright notice and this permission notice in all copies or substantial portions."),
    "mpl": ("Its files are subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("The examples are free and unencumbered software released into the public domain by their author.",),
    "zlib": ("The sources are under the zlib license.",),
}
UNKNOWN = "unknown"
DECOYS = (
    "She renewed her driver's license at the public office on Monday.", "The apache helicopter flew north with a general on board.",
    "Students of MIT released a new version of the public timetable.", "The software was released without a word of warning to any person.",
    "His license plate was copied down by the general public.", "Either version of the story may be used, or modified later.",
    "The work of the foundation is free and open to the public.", "Conditions on the road were as published by the ministry.",
    "Copyright law and warranty claims were discussed in the debate.", "Permission to build was granted under the terms of the treaty.",
    "A fishing license is required by law.", "The notice above the source of the river must be retained.", "The lesser of the two evils is free trade.",
    "The bakery is licensed to sell alcohol.", "Creative people are common in this city, version after version.", "Mozilla and other projects were mentioned.",
    "Under the bridge the express train stopped, without conditions.", "The file was distributed in writing to all agents.",
    "The eclipse was visible to the public for two minutes.", "A boost for the local software industry was announced.", "No damages were paid for any purpose.",
)
HELD_DECOYS = (
    "The pilot kept his license in a drawer with other documents.", "The ministry released a public version of the report under the terms of the act.", "Any person may obtain a copy of the map at the office, free of charge.",
    "The general was free to use the library for any purpose.", "Volunteers distribute the paper without fee in all parts of the town.", "The above figures were published by the foundation in 2.0 million copies.",
    "The restaurant has a licence to sell wine, subject to the following rules of the council.", "Students may use, copy and modify the drawings in class.",
)
PROSE = (
    "The committee met on Tuesday to talk about the new school in the valley.", "Heavy rain fell over the coast and the ferries were late again.",
    "He wrote three letters to his sister and never sent one of them.", "Prices for fresh fish rose by four percent in the last quarter.",
    "A small group of walkers found the old mill behind the wood.", "of the and to in is was for on with as by at from this that be it are an or",
)
MIN_CONFIDENCE = 0.3
MIN_CONTAINMENT = 0.4
#: A line break that only wraps: no sentence ends before it, and a small letter or a bracket follows, perhaps after a comment's mark.
WRAP = r"(?<![.!?:;\s])[ \t]*\r?\n[ \t]*(?:(?:#+|//+|\*|--|;+|>)[ \t]*)?(?=[a-z(])"


def _variants(text: str) -> list[str]:
    """A template as found in the wild: in capitals, within a sentence, with another year or file around it."""
    return [text, text.upper(), f"/* {text} */", f"# {text}", f"Note: {text}", f"{text} See the file LICENSE for details."]


def _features(spark: SparkSession, stages: list) -> Pipeline:
    vocabulary = spark.createDataFrame([(t,) for texts in TEMPLATES.values() for t in texts], "paragraph string")
    words = RegexTokenizer(inputCol="paragraph", outputCol="w1", pattern=r"[a-z0-9]+(?:[.'-][a-z0-9]+)*", gaps=False, toLowercase=True)
    bigrams = NGram(n=2, inputCol="w1", outputCol="w2")
    both = SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__")
    known = both.transform(bigrams.transform(words.transform(vocabulary))).select(F.explode("grams").alias("g")).distinct().orderBy("g")
    terms = [r["g"] for r in known.collect()]  # the templates' n-grams
    vector = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="features", minTF=1.0)
    vector.setBinary(True)
    return Pipeline(stages=[words, bigrams, both, vector, *stages])


class LicenseClassifier:
    """Trained on the templates' variants, the decoys and prose: their number is fixed by this module."""

    def __init__(self, spark: SparkSession):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        shown, kept = [], []
        for k, family in enumerate(sorted(TEMPLATES)):
            shown += [(v, float(k)) for text in TEMPLATES[family] for v in _variants(text)]
            kept += [(text, float(k)) for text in HELD_OUT[family]]
        shown += [(v, float(len(TEMPLATES))) for text in (*DECOYS, *PROSE) for v in (text, text.upper(), f"Note: {text}")]
        kept += [(text, float(len(TEMPLATES))) for text in HELD_DECOYS]
        shown += [("", float(len(TEMPLATES)))] * 8
        model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001, elasticNetParam=0.3, standardization=False)
        rows = spark.createDataFrame(shown, "paragraph string, label double").coalesce(1)
        self.model: PipelineModel = _features(spark, [model]).fit(rows)
        held = self._confident(spark.createDataFrame(kept, "paragraph string, label double").coalesce(1))
        unknown = float(len(TEMPLATES))
        r = held.agg(
            F.max(F.when(F.col("label") == unknown, F.col("confidence"))).alias("decoy"),
            F.min(F.when((F.col("label") != unknown) & (F.col("best") == F.col("label")), F.col("confidence"))).alias("variant"),
        ).first()
        #: Between the most confident held-out decoy and the least confident held-out variant.
        self.threshold = max(MIN_CONFIDENCE if (r["decoy"] or 0) < MIN_CONFIDENCE else (r["decoy"] + max(r["decoy"], r["variant"] or 1.0)) / 2, 0.0)

        words, bigrams = self.model.stages[0], self.model.stages[1]
        texts = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "f string, paragraph string")
        rows = bigrams.transform(words.transform(texts)).select("f", "w1", "w2").collect()  # of this module's templates
        #: The templates' distinct bigrams, with their family; an identifier is one word.
        self.templates = [(r["f"], sorted(set(r["w2"] or r["w1"]))) for r in rows]

    def _compared(self) -> Column:
        """Literal array of the templates: family, grams, need (how many make MIN_CONTAINMENT)."""
        return F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, t)).alias("grams"), F.lit(math.ceil(MIN_CONTAINMENT * len(t))).alias("need")) for f, t in self.templates])

    def confirmable(self, rows: DataFrame) -> DataFrame:
        """The rows whose paragraph reaches MIN_CONTAINMENT for a template of any family: no other can be confirmed."""
        every = sorted({g for _, t in self.templates for g in t})
        # Terms that are enough by themselves.
        single = sorted({g for _, t in self.templates for g in t if math.ceil(MIN_CONTAINMENT * len(t)) == 1})
        read = self.model.stages[1].transform(self.model.stages[0].transform(rows))
        # An array of one, so that the shared terms are looked up once.
        shared = F.array(F.array_distinct(F.filter(F.concat("w1", "w2"), lambda g: g.isin(every))))
        meets = lambda h: F.exists(self._compared(), lambda t: (t["need"] <= F.size(h)) & (F.size(F.array_intersect(h, t["grams"])) >= t["need"]))
        return read.where(F.exists(shared, lambda h: F.exists(h, lambda g: g.isin(single)) | (F.size(h) > 1) & meets(h))).select(*rows.columns)

    def _confident(self, rows: DataFrame) -> DataFrame:
        """Adds best (class with the greatest probability among the families) and confidence."""
        p = self.model.transform(rows).withColumn("p", F.slice(vector_to_array("probability"), 1, len(self.families) - 1))
        return p.withColumn("confidence", F.array_max("p")).withColumn("best", (F.array_position("p", F.col("confidence")) - 1).cast("double"))

    def classify(self, rows: DataFrame) -> DataFrame:
        """rows with a column paragraph. Adds family (unknown where not confident), confidence, containment, confirmed."""
        named = self._confident(rows)
        family = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.col("best").cast("int") + 1)
        named = named.withColumn("family", F.when(F.col("confidence") >= self.threshold, family).otherwise(F.lit(UNKNOWN)))
        own = F.filter(self._compared(), lambda t: t["family"] == F.col("family"))
        containment = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect("grams", t["grams"])) / F.size(t["grams"])))
        return named.withColumn("containment", F.coalesce(containment, F.lit(0.0))).withColumn("confirmed", F.col("containment") >= MIN_CONTAINMENT)


def scan_licenses(docs: DataFrame, classifier: LicenseClassifier) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, families (sorted names of confirmed notices, comma-joined), notices (array of
    paragraph number, family, confidence, containment), one row per document.

    Whole texts are read line by line, after wrapped lines have been joined. Lines that share too few terms with every template
    to be confirmed as any family are not classified; all others are. Null and empty texts have no notice and families ''; of
    families of one confidence the first in order counts; repeated rows and ids are scanned row by row; extra columns are
    not carried; an empty table gives an empty result. Blank lines are no paragraphs.
    """
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", WRAP, " "), "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("paragraph"))), lambda x: F.length(F.trim(x["paragraph"])) > 0)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(lines, F.array().cast("array<struct<no:int,paragraph:string>>")).alias("lines"))
    # A document's own number of paragraphs needs no shuffle; only the few notices are grouped.
    paragraphs = rows.select("doc_id", "text_hash", F.explode("lines").alias("x")).select("doc_id", "text_hash", "x.*")
    notices = classifier.classify(classifier.confirmable(paragraphs)).where("confirmed").select("doc_id", "text_hash", "no", "family", "confidence", "containment").distinct()
    found = notices.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(
        F.array_sort(F.collect_list(F.struct("no", "family", "confidence", "containment"))).alias("notices")
    )
    joined = rows.select("doc_id", "text_hash", F.size("lines").cast("bigint").alias("n_paragraphs")).join(
        found, (F.col("text_hash") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left"
    )
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",")
    return joined.select("doc_id", "n_paragraphs", F.coalesce(F.size("notices"), F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce(families, F.lit("")).alias("families"), "notices")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), LicenseClassifier(spark)).drop("notices")
