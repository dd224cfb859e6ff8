"""Licence scan: TF-IDF similarity of licence statements to templates, and inheritance down the directories.

Paragraphs and lines that speak of licensing, runs of lines around the latter, and whole licence files are compared with the
templates as sparse TF-IDF vectors. Tasks hold the templates and drop at once what cannot be similar enough, by an
exact bound; only the rest meets the frequencies of its other terms. A document that is a licence file, by its
name or because it holds nothing else, licenses its directory: documents without a statement of their own take
the licence of the nearest directory above them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import attach_groups, sql_type
from ticketlens.session import reliable_checkpoint

# --- Fixed values: licence notices, as their publishers word them ---------------
NOTICES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files, to deal in the Software without restriction",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction, including'
        " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"
        " of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:",
    ),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met:",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met; neither the name of the copyright holder nor the names of its contributors",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("ISC", "Licensed under the ISC License"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Licences with the same notices but for their name and version.
GNU = (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)
GNU_NOTICES = (
    "This work is licensed under the {name}, version {version}",
    "Licensed under the {name}, version {version}",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name}"
    " as published by the Free Software Foundation, either version {version} of the License",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {name}"
    " as published by the Free Software Foundation, either version {version} of the License, or (at your option) any"
    " later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {name}"
    " version {version} as published by the Free Software Foundation.",
)
#: SPDX identifiers; those of the GNU licences end in `-only` or `-or-later`, or, before 2018, in nothing or `+`.
IDENTIFIERS = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "CC-BY-ND-4.0", "Unlicense",
)
#: What speaks of licensing.
CUE = (
    r"(?i)\blicen[cs]ed?\b|\bcopyright\b|\bspdx|\bpublic domain\b|\bredistribut|\bpermission is hereby\b"
    r"|\bsubject to the terms\b|\bunencumbered\b"
)
#: Names of licence files.
FILE_NAMES = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
# ------------------------------------------------------------------------------

TEMPLATES = (
    *NOTICES,
    *((key, notice.format(name=name, version=version)) for key, name, version in GNU for notice in GNU_NOTICES),
    *((key, f"SPDX-License-Identifier: {key}") for key in IDENTIFIERS),
    *((key, f"SPDX-License-Identifier: {key}{end}") for key, _, _ in GNU for end in ("", "-only", "-or-later")),
)

#: Cosine from which a statement is taken for a template.
SIMILAR = 0.75
#: A text of which a statement this similar makes up this part is a licence file whatever its name.
WHOLE = 0.9
#: Lines around a line that speaks of licensing: notices are often wrapped.
BEFORE, AFTER = 2, 6
#: Units whose matches a task remembers.
REMEMBERED = 50_000


def _terms(text: Column) -> Column:
    """Words and numbers in lower case, and pairs of neighbours, which tell versions and variants apart."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda word: word != "")
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def _frequencies(units: DataFrame) -> DataFrame:
    """(term, count): in how many rows of (unit) each term occurs; counted in tasks before the only shuffle."""
    return units.select(F.explode(F.array_distinct(_terms(F.col("unit")))).alias("term")).groupBy("term").count()


def _template_index(known: DataFrame, idf: DataFrame, templates) -> dict[str, tuple[float, list[tuple[int, float]]]]:
    """Of each term of a template: its idf, and the templates that have it with their unit weights."""
    found = known.select("uid", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("uid", "term").count()
    found = idf.select("term", "idf").join(F.broadcast(found.withColumnRenamed("count", "times")), "term")
    rows = found.collect()  # as many as the templates have terms
    squares = [0.0] * len(templates)
    for row in rows:
        squares[row.uid] += ((1 + math.log(row.times)) * row.idf) ** 2
    index: dict[str, tuple[float, list[tuple[int, float]]]] = {}
    for row in sorted(rows, key=lambda row: (row.uid, row.term)):
        weight = (1 + math.log(row.times)) * row.idf / math.sqrt(squares[row.uid])
        index.setdefault(row.term, (row.idf, []))[1].append((row.uid, weight))
    return index


def _candidates(units: DataFrame, index: dict, names: list[str], similar: float) -> DataFrame:
    """(*keys, license, product, square, rest) of the rows (*keys, unit) that may be as similar to a template as asked for.

    `product` is with the best template, `square` the squared length over template terms, `rest` the other terms. These weigh
    at least their logarithmic count, as no idf is below 1, which bounds the cosine before any other idf is known.
    """
    held = units.sparkSession.sparkContext.broadcast((index, names))
    keys = [name for name in units.columns if name != "unit"]

    def match(terms: list[str]):
        index, names = held.value
        products: dict[int, float] = {}
        square = least = 0.0
        rest = []
        for term, times in Counter(terms).items():
            share = 1 + math.log(times)
            if term in index:
                idf, templates = index[term]
                square += (share * idf) ** 2
                for template, weight in templates:
                    products[template] = products.get(template, 0.0) + share * idf * weight
            else:
                least += share * share
                rest.append({"term": term, "times": times})
        if not products:
            return None
        product, name = max((round(value, 12), names[template]) for template, value in products.items())
        if product / math.sqrt(square + least) < similar - 1e-9:
            return None
        return name, product, square, rest

    entry = pa.list_(pa.struct([("term", pa.string()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, object] = {}
        for rows in batches:
            uids = rows.column(names_in.index("uid")).to_pylist()
            terms = rows.column(len(names_in) - 1)
            found = []
            for i, uid in enumerate(uids):
                if uid not in kept:
                    if len(kept) >= REMEMBERED:
                        kept.clear()
                    kept[uid] = match(terms[i].as_py())
                found.append(kept[uid])
            chosen = [i for i, value in enumerate(found) if value is not None]
            part = rows.take(pa.array(chosen, pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.float64(), entry)
            columns = [pa.array([found[i][k] for i in chosen], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(keys))), *columns], names=[*keys, "license", "product", "square", "rest"]
            )

    given = units.select(*keys, _terms(F.col("unit")).alias("terms"))
    names_in = given.columns
    schema = ", ".join(f"{key} {sql_type(units, key)}" for key in keys)
    return given.mapInArrow(
        run, f"{schema}, license string, product double, square double, rest array<struct<term:string,times:int>>"
    )


def _similarities(candidates: DataFrame, idf: DataFrame, n: int) -> DataFrame:
    """(uid, license, similarity) of (uid, license, product, square, rest), each uid once."""
    keys = ["uid", "license", "product", "square"]
    entries = candidates.select(*keys, F.explode_outer("rest").alias("entry"))
    entries = entries.select(*keys, F.coalesce("entry.term", F.lit("")).alias("term"), F.col("entry.times").alias("times"))
    weighed = attach_groups(entries, idf, ["term"], "count", n)
    weight = (1 + F.log("times")) * F.col("idf")
    lengths = weighed.groupBy(*keys).agg(F.coalesce(F.sum(weight * weight), F.lit(0.0)).alias("more"))
    return lengths.select(
        "uid", "license", F.round(F.col("product") / F.sqrt(F.col("square") + F.col("more")), 9).alias("similarity")
    )


def _known(spark: SparkSession, templates) -> DataFrame:
    rows = [(i, text) for i, (_, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "uid long, unit string").coalesce(1)


def _idf(frequencies: DataFrame, n: int) -> DataFrame:
    """(term, count, idf), written once."""
    idf = F.log((F.lit(n) + 1) / (F.col("count") + 1)) + 1
    return reliable_checkpoint(frequencies.groupBy("term").agg(F.sum("count").alias("count")).withColumn("idf", idf))


def similar_templates(units: DataFrame, templates=TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """(uid, license, similarity) of the texts (uid, unit), each given once, that a template resembles.

    Document frequencies are over all units and templates. Units without a term of a template are left out, as are null
    and empty ones; an empty table gives no rows.
    """
    known = _known(units.sparkSession, templates)
    added = known.where(~_given(known, units)).dropDuplicates(["unit"])
    n = units.count() + added.count()
    idf = _idf(_frequencies(units).union(_frequencies(added)), n)
    index = _template_index(known, idf, templates)
    candidates = _candidates(units.select("uid", "unit").where("unit is not null"), index, [name for name, _ in templates], similar)
    found = _similarities(reliable_checkpoint(candidates), idf, n)
    return found.where(F.col("similarity") >= similar)


def _given(known: DataFrame, units: DataFrame) -> Column:
    """Whether a template is itself among the units, so that it counts once."""
    texts = [row.unit for row in known.select("unit").distinct().collect()]
    same = units.where(F.col("unit").isin(texts)).select("unit").distinct().collect()
    return F.col("unit").isin([row.unit for row in same]) if same else F.lit(False)


def _units(text: Column, named: Column) -> Column:
    """What of a text is compared: its statements, each once, with white space tidied.

    These are the paragraphs that speak of licensing, their lines that do, alone and in all runs of up to BEFORE
    lines before to AFTER lines after, and the same window whatever blank lines it has. Paragraphs end at lines without a letter or digit,
    blank ones as well as those of comment blocks. A text is also compared whole when it is `named` a licence file or
    such paragraphs are half of it.
    """
    lines = F.split(text, r"\n")
    speaks = lambda piece: F.rlike(piece, F.lit(CUE))
    paragraphs = F.filter(F.split(text, r"\n[^\p{L}\p{N}]*\n"), speaks)

    def places(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda line, i: F.when(speaks(line), i)), lambda i: i.isNotNull())

    def run(lines: Column, first: Column, last: Column) -> Column:
        first = F.greatest(first, F.lit(0))
        return F.array_join(F.slice(lines, first + 1, last + 1 - first), " ")

    def runs(lines: Column) -> Column:
        ends = [(before, after) for before in range(BEFORE + 1) for after in range(AFTER + 1)]
        return F.flatten(F.transform(places(lines), lambda i: F.array(*[run(lines, i - x, i + y) for x, y in ends])))

    def once(array: Column, made) -> Column:
        """`made` of the array, which is computed once rather than in each inner function."""
        return F.get(F.transform(F.array(array), made), 0)

    inside = F.flatten(F.transform(paragraphs, lambda paragraph: once(F.split(paragraph, r"\n"), runs)))
    around = once(lines, lambda lines: F.transform(places(lines), lambda i: run(lines, i - BEFORE, i + AFTER)))
    spoken = F.aggregate(paragraphs, F.lit(0), lambda total, paragraph: total + F.length(paragraph))
    whole = F.when(F.coalesce(named, F.lit(False)) | (2 * spoken >= F.length(text)), F.array(text))
    pieces = F.concat(inside, around, paragraphs, F.coalesce(whole, F.array().cast("array<string>")))
    tidy = F.transform(pieces, lambda piece: F.trim(F.regexp_replace(piece, r"\s+", " ")))
    return F.when(speaks(text), F.array_distinct(tidy))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def license_scan(
    docs: DataFrame,
    path_col: str = "path",
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    similar: float = SIMILAR,
) -> DataFrame:
    """(doc_id, path, license, similarity, basis, license_dir): one row for each row of `docs`.

    `basis` is `own` when the text has a statement like a template (the most similar; of equals the last name),
    `inherited` when the nearest directory above has a licence file with one, else null. `license_dir` is
    that directory; the root is the empty string. A null path stands in no directory and inherits nothing. Null texts are empty. Of several
    licence files in a directory the most similar counts. Rows and ids may repeat or be null; an empty table gives no
    rows; other columns play no part.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{path_col}`").cast("string").alias("path"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    named = F.coalesce(F.rlike("path", F.lit(FILE_NAMES)), F.lit(False))
    speaks = F.rlike("text", F.lit(CUE))
    # Each distinct text that speaks of licensing is kept once; copies are combined in tasks.
    said = rows.where(speaks).select(F.xxhash64("text").alias("mark"), "text", named.alias("named"))
    said = said.groupBy("mark").agg(
        F.first("text").alias("text"), F.max("named").alias("named"), F.count(F.lit(1)).alias("copies")
    )
    said = reliable_checkpoint(said)
    texts = reliable_checkpoint(_text_licenses(said, templates, similar))
    # Ids and paths of all rows; texts do not leave the scan.
    places = rows.select(
        "doc_id", "path", F.when(speaks, F.xxhash64("text")).alias("mark"), _directory(F.col("path")).alias("directory")
    )
    places = reliable_checkpoint(places)
    n_rows = places.count()
    silent = places.where("mark is null").withColumn("own", F.lit(None).cast(texts.schema["own"].dataType))
    speaking = attach_groups(places.where("mark is not null"), texts, ["mark"], "copies", n_rows)
    file = F.rlike("path", F.lit(FILE_NAMES)) | (F.col("part") >= WHOLE)
    directories = speaking.where(F.col("path").isNotNull() & F.col("own").isNotNull() & file).groupBy("directory").agg(
        F.max("own").alias("given")
    )
    directories = reliable_checkpoint(directories)
    # Each distinct directory meets the ones above it; there are as many as its path has parts.
    own = places.where("directory is not null").groupBy("directory").agg(F.count(F.lit(1)).alias("members"))
    parts = F.split("directory", "/")
    ups = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up"))
    )
    above = own.select("directory", "members", F.explode(F.array_distinct(ups)).alias("u"))
    above = above.select("directory", "members", "u.depth", F.col("u.up").alias("up"))
    given = directories.withColumnRenamed("directory", "up")
    nearest = above.join(given, "up").groupBy("directory").agg(
        F.max_by(F.struct("up", "given"), "depth").alias("nearest"), F.max("members").alias("members")
    )
    nearest = reliable_checkpoint(nearest)
    names = ["doc_id", "path", "directory", "own"]
    joined = attach_groups(silent.select(*names).unionByName(speaking.select(*names)), nearest, ["directory"], "members", n_rows)
    inherited = F.col("own").isNull() & F.col("nearest").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own.license", "nearest.given.license").alias("license"),
        F.coalesce("own.similarity", "nearest.given.similarity").alias("similarity"),
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").alias("basis"),
        F.when(inherited, F.col("nearest.up")).alias("license_dir"),
    )


def _text_licenses(said: DataFrame, templates, similar: float) -> DataFrame:
    """(mark, copies, own, part) of the distinct texts (mark, text, named, copies) that have a statement like a template.

    Document frequencies are over these texts and the templates; statements overlap, so counting them would count a
    line up to 22 times. Statements are made and compared where the text is; only those that may be similar enough
    are written.
    """
    known = _known(said.sparkSession, templates)
    n = said.count() + len(templates)
    idf = _idf(_frequencies(said.select(F.col("text").alias("unit"))).union(_frequencies(known)), n)
    index = _template_index(known, idf, templates)
    units = said.select("mark", "copies", F.length("text").alias("size"), F.explode(_units(F.col("text"), F.col("named"))).alias("unit"))
    units = units.select("mark", "copies", "size", F.xxhash64("unit").alias("uid"), F.length("unit").alias("length"), "unit")
    found = reliable_checkpoint(_candidates(units, index, [name for name, _ in templates], similar))
    # A statement that many texts make is weighed once.
    names = ["license", "product", "square", "rest"]
    once = found.groupBy("uid").agg(F.first(F.struct(*names)).alias("first"), F.count(F.lit(1)).alias("uses"))
    once = reliable_checkpoint(once.select("uid", "uses", "first.*"))
    alike = _similarities(once, idf, n).where(F.col("similarity") >= similar)
    alike = alike.join(once.select("uid", "uses"), "uid")
    spoken = attach_groups(found.select("mark", "copies", "size", "uid", "length"), alike, ["uid"], "uses", n)
    return spoken.where("similarity is not null").groupBy("mark").agg(
        F.max("copies").alias("copies"),
        F.max(F.struct("similarity", "license")).alias("own"),
        # How much of the text is nothing but the statement.
        (F.max(F.when(F.col("similarity") >= WHOLE, F.col("length"))) / F.max("size")).alias("part"),
    )
