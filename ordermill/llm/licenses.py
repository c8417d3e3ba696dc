"""License notices found by MinHash bands over overlapping windows, then verified (operator 5).

Texts are taken as lower-case words of letters and digits. Windows overlap; a window's signature is, per band, the least of
its shingles' hashes under that band's order of the hashes. Windows of notices are taken at every word, windows of texts
at every STRIDE-th, so a notice of ``long`` length that stands in a text whole has windows there that equal windows of the notice: all bands
collide, with certainty. For windows of Jaccard similarity J, ``bands`` single-row bands collide with probability 1 - (1 - J)^bands:
0.9999 at 0.8 and 0.996 at 0.6 with six bands, and a near copy has many windows. Shorter notices
use windows of one shingle at every word, whose signature is the shingle; one common shingle retrieves the notice.

A retrieved notice is verified exactly: at least the wanted share of its distinct shingles, as text, occurs in the document.

Built-in functions only, within the row: no shuffle, no join. The notices are a bounded list of literals.

Defined results: a null or empty text, or one of fewer words than a shingle, holds no notice; repeated rows get a
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

# Public license notices.
NOTICES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

SHINGLE_WORDS = 5
#: Shingles in a window of a long notice, words from one window of a text to the next, single-row bands.
WINDOW = 4
STRIDE = 4
BANDS = 6
#: A notice is long if any whole copy must hold an aligned window: window and stride together, in shingles.
LONG = WINDOW + STRIDE - 1
CONTAINMENT = 0.8
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def places(count: Column, step: int = 1) -> Column:
    """0, step, ... below count; nothing if count is not above zero."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: str) -> Column:
    at = places(F.size(words) - (SHINGLE_WORDS - 1))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]))


def shingle_texts(words: str) -> Column:
    at = places(F.size(words) - (SHINGLE_WORDS - 1))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE_WORDS)])))


def band_key(band: int) -> int:
    """Hashes are ordered by their value after an exclusive or with the band's key."""
    return (0x5851F42D4C957F2D * (2 * band + 1)) % (1 << 64) - (1 << 63)


def band_signatures(band: int, stride: int) -> Column:
    # the reordered hashes are named twice, else the optimizer would compute them anew for every window
    ordered = f"_order{band}"
    return F.transform(places(F.size(ordered) - (WINDOW - 1), stride), lambda i: F.array_min(F.slice(ordered, i + 1, WINDOW)))


def reordered(hashes: str, key: int) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(key)))


def with_orders(frame: DataFrame, hashes: str = "_hashes") -> DataFrame:
    return frame.withColumns({f"_order{b}": reordered(hashes, band_key(b)) for b in range(BANDS)})


@dataclass(frozen=True)
class Notice:
    name: str
    shingles: list[str]
    short: list[int]  # hashes, for a short notice
    bands: list[list[int]]  # signatures by band, for a long one


def prepared(spark: SparkSession, notices: dict[str, str]) -> list[Notice]:
    """Notices as shingles and signatures, by the same expressions as texts; one row each."""
    rows = spark.createDataFrame(sorted(notices.items()), "name string, text string").withColumn("_words", tokens(F.col("text")))
    rows = with_orders(rows.withColumns({"_hashes": shingle_hashes("_words"), "_texts": shingle_texts("_words")}))
    signatures = F.array(*[band_signatures(b, 1) for b in range(BANDS)])
    out = []
    for r in rows.select("name", "_texts", "_hashes", signatures.alias("_bands")).collect():
        is_long = len(r["_hashes"]) >= LONG
        bands = [sorted(set(b)) for b in r["_bands"]]
        out.append(Notice(r["name"], r["_texts"], [] if is_long else sorted(set(r["_hashes"])), bands if is_long else [[]] * BANDS))
    return [n for n in out if n.shingles]


def literals(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def scan(docs: DataFrame, notices: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` (doc_id) with ``found``, an array of (name, share) of the notices they hold, by name."""
    known = prepared(docs.sparkSession, NOTICES if notices is None else notices)
    rows = docs.select("doc_id", tokens(F.col("text")).alias("_words")).withColumn("_hashes", shingle_hashes("_words"))
    rows = with_orders(rows).withColumns({f"_band{b}": band_signatures(b, STRIDE) for b in range(BANDS)})
    every_short = sorted({h for n in known for h in n.short})
    hits = {"_short": F.array_intersect("_hashes", literals(every_short, "bigint"))}
    for b in range(BANDS):
        every = sorted({h for n in known for h in n.bands[b]})
        hits[f"_hit{b}"] = F.array_intersect(f"_band{b}", literals(every, "bigint"))
    rows = rows.withColumns(hits)
    any_hit = F.size("_short") > 0
    for b in range(BANDS):
        any_hit |= F.size(f"_hit{b}") > 0
    rows = rows.select("doc_id", "_short", *[f"_hit{b}" for b in range(BANDS)], F.when(any_hit, shingle_texts("_words")).alias("_texts"))

    def verified(n: Notice) -> Column:
        retrieved = F.arrays_overlap("_short", literals(n.short, "bigint")) if n.short else F.lit(False)
        for b, signatures in enumerate(n.bands):
            if signatures:
                retrieved |= F.arrays_overlap(f"_hit{b}", literals(signatures, "bigint"))
        share = F.size(F.array_intersect("_texts", literals(n.shingles, "string"))) / F.lit(len(n.shingles))
        entry = F.struct(F.lit(n.name).alias("name"), share.alias("share"))
        return F.when(retrieved & (share >= containment), entry)

    kind = "array<struct<name:string,share:double>>"
    if not known:
        return rows.select("doc_id", F.array().cast(kind).alias("found"))
    found = F.when(F.col("_texts").isNotNull(), F.array_compact(F.array(*[verified(n) for n in known])))
    return rows.select("doc_id", F.coalesce(found.cast(kind), F.array().cast(kind)).alias("found"))


def containment_sql() -> str:
    """The same question without retrieval: every notice against every document."""
    notices = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(NOTICES.items()))
    return rf"""
with notices(name, body) as (values {notices}),
cut as (select name, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as w from notices),
wanted as (
    select name, list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))) as s
    from cut),
texts as (
    select row_number() over () as row, doc_id,
           list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as w
    from documents),
held as (
    select row, doc_id, list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))) as s
    from texts),
matched as (
    select h.row, n.name from held h, wanted n
    where len(list_intersect(h.s, n.s)) >= {CONTAINMENT} * len(n.s))
select h.doc_id, coalesce(string_agg(m.name, ',' order by m.name), '') as licenses, count(m.name)::int as n_licenses
from held h left join matched m on m.row = h.row group by h.row, h.doc_id
"""


@query(containment_sql())
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.transform("found", lambda x: x["name"])
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("found").alias("n_licenses"))
