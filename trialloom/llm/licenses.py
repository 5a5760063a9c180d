"""Licences of files by TF-IDF cosine to templates, inherited from the nearest directory.

Every line and every whole text is a sparse vector of words, weighted by how rare a word is among
all files. The best template of a line names the file's own licence. Only lines and texts with one
of the heavy words of a template are weighed: without those words no cosine can reach the
threshold, as the rest of each template's weight is too small. A file whose whole text is close to a template is a licence file and speaks
for its directory; a file without an own licence takes that of the nearest directory above it.
DataFrame and SQL operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.session import staged

#: Licence names and their usual notices; a parameter.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}', 0)"


def _heavy(ideal: DataFrame, threshold: float) -> str:
    """Pattern of the heaviest words of each template, all but a share too small for the threshold.

    A unit without any of them has a cosine of at most the root of that share. The words are
    among those of the templates, so their number is bounded.
    """
    by_weight = Window.partitionBy("template").orderBy(F.col("template_w").desc(), "term")
    square = F.expr("template_w * template_w")
    rest = F.sum(square).over(by_weight.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    share = ideal.withColumn("share", rest / F.expr("template_norm * template_norm"))
    words = [r[0] for r in share.where(F.col("share") >= (threshold - 1e-6) ** 2).select("term").distinct().collect()]
    return "(?<![a-z0-9])(?:" + "|".join(w.replace(".", "[.]") for w in sorted(words)) + ")(?![a-z0-9])"


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, found, cosine and from_dir of every row of ``files`` (path, text).

    ``found`` is ``own``, ``inherited`` or ``none``; ``cosine`` (six digits) is that of the notice
    that named the licence. Ties go to the smaller licence name. A null or empty text has no own
    licence; a null path has none at all. Rows of the same path are one file: the best of their
    notices counts for each of them. Other columns are not read; an empty table gives an empty
    table. Templates are a bounded parameter, so their words may be broadcast.
    """
    spark = files.sparkSession
    files = files.select("path", "text")
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    terms = known.selectExpr("template", "license", f"explode({_words('text')}) as term").groupBy(
        "template", "license", "term"
    ).agg(F.count("*").alias("tf"))
    total = files.count()
    never = f"(ln({total}D + 1) + 1)"
    in_file = f"explode(array_distinct({_words('text')})) as term"
    counts = files.selectExpr(in_file).groupBy("term").agg(F.count("*").alias("df"))
    rare = staged(counts.selectExpr("term", f"ln(({total}D + 1) / (df + 1)) + 1 as idf"), "idf")

    def weighted(rows: DataFrame) -> DataFrame:
        return rows.join(rare, "term", "left").withColumn("w", F.expr(f"tf * coalesce(idf, {never})")).drop("tf", "idf")

    ideal = weighted(terms)
    lengths = ideal.groupBy("template").agg(F.sqrt(F.sum(F.expr("w * w"))).alias("template_norm"))
    ideal = ideal.withColumnRenamed("w", "template_w").join(F.broadcast(lengths), "template")

    speaks = f"rlike '{_heavy(ideal, threshold)}'"
    speaking = files.where(f"path is not null and lower(text) {speaks}")
    lines = speaking.select("path", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    units = lines.where(f"lower(part) {speaks}").unionAll(speaking.selectExpr("path", "-1 as line", "text as part"))
    units = units.withColumn("unit", F.xxhash64("part"))  # rows of one path may hold different texts
    each = units.selectExpr("path", "line", "unit", f"explode({_words('part')}) as term")
    vectors = staged(weighted(each.groupBy("path", "line", "unit", "term").agg(F.count("*").alias("tf"))), "vectors")
    key = ["path", "line", "unit"]
    norms = vectors.groupBy(*key).agg(F.sqrt(F.sum(F.expr("w * w"))).alias("norm"))
    dots = vectors.join(F.broadcast(ideal), "term").groupBy(*key, "template", "license", "template_norm").agg(
        F.sum(F.expr("w * template_w")).alias("dot")
    )
    close = dots.join(norms, key).withColumn("cosine", F.expr("round(dot / (norm * template_norm), 6)"))
    close = close.where(F.col("cosine") >= threshold)
    best = "struct(-cosine as below, license)"
    by_file = close.selectExpr("path", f"{best} as own", f"case when line = -1 then {best} end as whole")
    by_file = by_file.groupBy("path").agg(F.min("own").alias("own"), F.min("whole").alias("whole"))
    by_file = staged(by_file, "licensed")

    place = "case when path like '%/%' then regexp_replace(path, '/[^/]*$', '') else '' end as dir"
    holders = by_file.where("whole is not null").selectExpr(place, "whole").groupBy("dir").agg(F.min("whole").alias("whole"))
    placed = files.selectExpr("path", place)
    above = placed.where("path is not null").select("dir").distinct().selectExpr(
        "dir", "explode(sequence(0, if(dir = '', 0, size(split(dir, '/'))))) as depth"
    ).selectExpr("dir", "depth", "array_join(slice(split(dir, '/'), 1, depth), '/') as from_dir")
    near = above.join(holders.withColumnRenamed("dir", "from_dir"), "from_dir").groupBy("dir").agg(
        F.max_by(F.struct("from_dir", "whole"), "depth").alias("near")
    )
    return (
        placed.join(by_file.select("path", "own"), "path", "left")
        .join(near, "dir", "left")
        .selectExpr(
            "path",
            "coalesce(own.license, if(path is null, null, near.whole.license)) as license",
            "case when own is not null then 'own' when path is not null and near is not null then 'inherited' else 'none' end as found",
            "-coalesce(own.below, if(path is null, null, near.whole.below)) as cosine",
            "case when own is null and path is not null then near.from_dir end as from_dir",
        )
    )
