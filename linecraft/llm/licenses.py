"""License scan: MinHash bands over overlapping windows retrieve notices, containment verifies them.

Words are lower-cased and rid of all but a-z and 0-9; a notice is its set of 5-word shingles (all its
words, where it has fewer).  A document carries a notice if 80 % of its shingles occur in the text.

The text is searched in overlapping windows, one width for each class of notice sizes (2^c words or
less): a window has 2 * 2^c words and starts every 2^c, so some window holds any whole notice.  Its
domain is its shingles that some notice of the class has; others cannot be shared.  With at most four
times a notice's shingles in a domain, 80 % containment means a Jaccard similarity of 0.19 or more,
and ``BANDS`` one-row bands miss such a pair with a probability below 1e-6.  Candidates that share a
band are verified exactly.  Only DataFrame operations are used; the notices are a fixed list, so
their broadcast is bounded.

Defined cases: null and empty texts carry no notice; rows that repeat doc_id and text give their
result once; ids may be null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

K, CONTAINED, BANDS = 5, 0.8, 66

#: Notices as their licenses word them, and the license that each stands for.
NOTICES = {
    "Apache-2.0 short": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "Apache-2.0 header": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "MIT short": ("MIT", "Released under the MIT License."),
    "MIT grant": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "GPL-3.0 work": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "GPL header": ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "LGPL header": ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL header": ("AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "BSD grant": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0 header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "ISC grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "CC BY-NC-4.0 short": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "CC BY-4.0 short": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "CC BY-SA-4.0 short": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "CC BY-4.0 work": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0 dedication": ("CC0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    "Unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "reserved": ("proprietary", "All rights reserved."),
}


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9\x20\x09-\x0D]+", "")
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, by place; null where there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(places, lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])))


def _holds(known: set[int] | list[int]):
    """The test whether a hit's hash is in a fixed list."""
    return lambda s: s["h"].isin(*sorted(known))


def _hits(k: int, known: set[int]) -> Column:
    """Places and hashes of the text's ``k``-word shingles that some notice has."""
    every = F.transform(_shingles(F.col("w"), k), lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    return F.coalesce(F.filter(every, _holds(known)), F.array().cast("array<struct<i:int,h:bigint>>"))


def _bands(domain: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(domain, lambda h: F.xxhash64(h, b))))


def _fixed(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from literals, without a Python worker."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def notice_sets(spark: SparkSession, notices: dict[str, tuple[str, str]]) -> list:
    """(notice, license, words of a shingle, size class, distinct shingles) of each notice."""
    rows = _fixed(spark, [{"notice": n, "license": x, "text": t} for n, (x, t) in notices.items()], "notice string, license string, text string")
    rows = rows.withColumn("w", F.explode(F.array(_words(F.col("text")))))
    k = F.least(F.size("w"), F.lit(K))
    out = rows.withColumn("k", k).withColumn("class", F.ceil(F.log2(F.size("w"))).cast("int"))
    by_k = None
    for n in range(1, K + 1):
        mine = F.array_distinct(_shingles(F.col("w"), n))
        by_k = F.when(F.col("k") == n, mine) if by_k is None else by_k.when(F.col("k") == n, mine)
    return out.filter("k > 0").select("notice", "license", "k", "class", by_k.alias("shingles")).collect()


def scan(docs: DataFrame, notices: dict[str, tuple[str, str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, notice, license, n_shingles, n_shared, containment and first_word of each notice found."""
    spark = docs.sparkSession
    sets = notice_sets(spark, notices or NOTICES)
    hashes: dict[int, set[int]] = {}
    for r in sets:
        hashes.setdefault(r["k"], set()).update(r["shingles"])
    found = [_hits(k, q) for k, q in sorted(hashes.items())]
    # explode of one element: the words are split once, not inside the lambdas that use them
    hits = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.array(_words(F.col("text")))).alias("w")).select("doc_id", "key", F.concat(*found).alias("hits"))
    hits = stored(hits.filter(F.size("hits") > 0).dropDuplicates(["doc_id", "key"]))
    known = _fixed(spark, [r.asDict() for r in sets], "notice string, license string, class int, shingles array<bigint>")
    parts = []
    for c in sorted({r["class"] for r in sets}):
        mine = sorted({h for r in sets if r["class"] == c for h in r["shingles"]})
        step = 1 << c
        each = hits.select("doc_id", "key", F.explode(F.filter("hits", _holds(mine))).alias("s"))
        block = F.floor(F.col("s.i") / step).cast("int")
        each = each.select("doc_id", "key", F.col("s.h").alias("h"), F.explode(F.array(block, block - 1)).alias("window")).filter("window >= 0")
        domains = each.groupBy("doc_id", "key", "window").agg(F.collect_set("h").alias("domain"))
        values = domains.select("doc_id", "key", F.posexplode(_bands(F.col("domain"))).alias("band", "value"))
        wanted = known.filter(F.col("class") == c).select("notice", F.posexplode(_bands(F.col("shingles"))).alias("b", "v"))
        parts.append(values.join(F.broadcast(wanted), (F.col("band") == F.col("b")) & (F.col("value") == F.col("v"))).select("doc_id", "key", "notice").distinct())
    pairs = reduce(DataFrame.unionByName, parts).toDF("id", "k", "notice")
    checked = pairs.join(hits, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).join(F.broadcast(known), "notice")
    own = F.filter("hits", lambda s: F.array_contains("shingles", s["h"]))
    checked = checked.withColumn("own", own).withColumn("n_shared", F.size(F.array_distinct(F.transform("own", lambda s: s["h"]))))
    checked = checked.withColumn("n_shingles", F.size("shingles")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return checked.filter(F.col("n_shared") >= contained * F.col("n_shingles") - 1e-9).select("doc_id", "notice", "license", "n_shingles", "n_shared", "containment", F.array_min(F.transform("own", lambda s: s["i"])).alias("first_word"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: x.replace("'", "''")
    values = ", ".join(f"('{quote(n)}', '{quote(x)}', '{quote(t)}')" for n, (x, t) in NOTICES.items())
    words = "list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x20\\x09-\\x0D]+', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    grams = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
    return f"""
WITH notices(notice, license, text) AS (VALUES {values}),
t AS (SELECT notice, license, w, least(len(w), {K}) AS k FROM (SELECT notice, license, {words} AS w FROM notices)),
ts AS (SELECT DISTINCT notice, license, k, {grams} AS g FROM t),
tn AS (SELECT notice, count(*) AS n FROM ts GROUP BY notice),
d AS (SELECT doc_id, {words} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM t),
ds AS (SELECT doc_id, k, {grams} AS g, generate_subscripts(range(1, len(w) - k + 2), 1) AS i FROM d, ks WHERE len(w) >= k),
m AS (SELECT ds.doc_id, ts.notice, ts.license, count(DISTINCT ds.g) AS s, min(ds.i) - 1 AS at0 FROM ds JOIN ts ON ts.g = ds.g AND ts.k = ds.k GROUP BY ALL)
SELECT doc_id, m.notice, license, n::INT AS n_shingles, s::INT AS n_shared, s / n AS containment, at0::INT AS first_word
FROM m JOIN tn USING (notice) WHERE s >= {CONTAINED} * n - 1e-9"""


ORACLE = _oracle()
