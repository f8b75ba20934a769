"""Operator 10: licence scan by sparse TF-IDF cosine, then directory inheritance.

Every window of 1 to ``WINDOW`` consecutive lines of a file (single lines, headers
wrapped over lines, the conditions of licence files) is compared with the templates.
Terms are words; the vocabulary is that of the templates, document frequencies are
counted over all files, and words outside the vocabulary weigh like a term that occurs
in one file only, so a notice has to make up most of its window. Texts of one family
differ by a version or a word, which cosine hardly sees: a template therefore needs all
its ``must`` terms in the window and none that only its relatives need. A file's own
licence is its SPDX tag, else the best template at or above ``THRESHOLD``. Files that
declare a licence for their directory pass it on: every other file takes that of its
nearest ancestor directory, found by joining its ancestor paths with the declaring
directories.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, store
from .tokens import ALNUM, text_blocks, words

THRESHOLD = 0.6
NEAR = 0.1
WINDOW = 24
BLOCK = 256             # window starts whose term counts are held at once


class Template(NamedTuple):
    licence: str        # SPDX identifier
    family: str         # relatives that must be told apart
    must: str           # required terms, alternatives joined by |; the first is looked for first
    text: str


_GPL = "gnu general public"
_GPL_TEXT = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General "
             "Public License as published by the Free Software Foundation, {}.")
_CC = "cc|creative|creativecommons by|attribution"
_CC_TEXT = "This work is licensed under a Creative Commons Attribution{} {} International License."
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
              "granted")


def _gnu(name: str, word: str, title: str, version: str, number: str, must: str) -> list[Template]:
    """Notices of one GNU licence: the bare version means that version only."""
    need = f"{_GPL} {word} {must}".replace("  ", " ")
    only, later = f"{name}-{version}-only", f"{name}-{version}-or-later"
    exact, choice = f"version {number}", f"either version {number} of the License, or (at your option) any later version"
    return [Template(only, "gnu", need, f"This work is licensed under the GNU {title}General Public License, version {number}."),
            Template(only, "gnu", need, _GPL_TEXT.format(title, exact)),
            Template(only, "gnu", need, f"GNU {title}GENERAL PUBLIC LICENSE Version {number} Copyright (C) Free Software "
                                        "Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this "
                                        "license document, but changing it is not allowed."),
            Template(later, "gnu", f"{need} later", _GPL_TEXT.format(title, choice)),
            Template(later, "gnu", f"{need} later", f"Licensed under the GNU {title}General Public License, version {number} "
                                                    "or any later version.")]


def _creative(kind: str, words_: str, must: str, version: str) -> list[Template]:
    name = f"CC-BY{kind}-{version}"
    need = f"{_CC} {must} {version[0]}".replace("  ", " ")
    return [Template(name, "creative", need, f"Licensed under CC BY{kind} {version}."),
            Template(name, "creative", need, _CC_TEXT.format(words_, version))]


# Usual notices and the conditions of short licences by SPDX identifier.
TEMPLATES = (
    Template("Apache-2.0", "apache", "apache 2|v2", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "apache", "apache 2|v2",
             "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License."),
    Template("Apache-2.0", "apache", "apache 2|v2",
             "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
             "Unless required by applicable law or agreed to in writing, software distributed under the License is "
             "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
             "See the License for the specific language governing permissions and limitations under the License."),
    Template("Apache-1.1", "apache", "apache 1", "Licensed under the Apache Software License, Version 1.1."),
    Template("MIT", "mit", "license|licence|licensed mit", "Released under the MIT License."),
    Template("MIT", "grant", "permission charge sublicense included",
             _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice "
             "shall be included in all copies or substantial portions of the Software."),
    Template("MIT-0", "grant", "permission charge sublicense", _MIT_GRANT + "."),
    Template("ISC", "grant", "permission fee appear",
             _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies."),
    Template("0BSD", "grant", "permission fee", _ISC_GRANT + "."),
    *_gnu("GPL", "", "", "2.0", "2", "2|v2"),
    *_gnu("GPL", "", "", "3.0", "3", "3|v3"),
    *_gnu("LGPL", "lesser", "Lesser ", "2.1", "2.1", "2|v2 1"),
    *_gnu("LGPL", "lesser", "Lesser ", "3.0", "3", "3|v3"),
    *_gnu("AGPL", "affero", "Affero ", "3.0", "3", "3|v3"),
    *_creative("", "", "", "4.0"), *_creative("", "", "", "3.0"),
    *_creative("-SA", "-ShareAlike", "sa|sharealike", "4.0"), *_creative("-SA", "-ShareAlike", "sa|sharealike", "3.0"),
    *_creative("-NC", "-NonCommercial", "nc|noncommercial", "4.0"),
    *_creative("-ND", "-NoDerivatives", "nd|noderivatives|noderivs", "4.0"),
    *_creative("-NC-SA", "-NonCommercial-ShareAlike", "nc|noncommercial sa|sharealike", "4.0"),
    *_creative("-NC-ND", "-NonCommercial-NoDerivatives", "nc|noncommercial nd|noderivatives|noderivs", "4.0"),
    Template("CC0-1.0", "cc0", "cc0 1", "Dedicated to the public domain under CC0 1.0 Universal."),
    Template("BSD-2-Clause", "bsd", "bsd 2|two clause", "Licensed under the BSD 2-Clause License."),
    Template("BSD-3-Clause", "bsd", "bsd 3|three clause", "Licensed under the BSD 3-Clause License."),
    Template("BSD-2-Clause", "conditions", "redistribution binary reproduce", _BSD_CONDITIONS),
    Template("BSD-3-Clause", "conditions", "redistribution binary reproduce endorse",
             _BSD_CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to "
             "endorse or promote products derived from this software without specific prior written permission."),
    Template("MPL-2.0", "mozilla", "mozilla 2|v2",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("MPL-2.0", "mozilla", "mozilla 2|v2",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
             "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("MPL-1.1", "mozilla", "mozilla 1",
             "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
             "use this file except in compliance with the License."),
    Template("EPL-2.0", "eclipse", "eclipse 2|v2",
             "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
             "2.0."),
    Template("EPL-2.0", "eclipse", "eclipse 2|v2", "Licensed under the Eclipse Public License, version 2.0."),
    Template("EPL-1.0", "eclipse", "eclipse 1|v1",
             "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
             "v1.0."),
    Template("EPL-1.0", "eclipse", "eclipse 1|v1", "Licensed under the Eclipse Public License, version 1.0."),
    Template("BSL-1.0", "boost", "boost 1", "Distributed under the Boost Software License, Version 1.0."),
    Template("Unlicense", "unlicense", "unencumbered domain",
             "This is free and unencumbered software released into the public domain."),
    Template("Zlib", "zlib", "altered misrepresented",
             "The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software. This notice may not be removed or altered from any source distribution."),
)

SPDX_TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?: +(?:AND|OR|WITH) +[A-Za-z0-9.+()-]+)*)"


def _hashes(texts):
    buf = np.frombuffer(b"".join(t.encode() for t in texts), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    h, _, _, first = words(buf, off, ALNUM)
    return [h[first[i]:first[i + 1]] for i in range(len(texts))]


def _vocabulary(templates):
    """Sorted terms of all templates, required ones included, and per template their counts."""
    per = _hashes([t.text for t in templates])
    terms = np.unique(np.concatenate(per + _hashes([t.must.replace("|", " ") for t in templates])))
    tf = np.zeros((len(terms), len(templates)))
    for t, h in enumerate(per):
        np.add.at(tf, (np.searchsorted(terms, h), t), 1.0)
    return terms, tf


def required_terms(templates) -> list[tuple[set[str], set[str]]]:
    """Per template the groups of terms a window must hold and those it must not: what
    other licences of the family need and this one doesn't."""
    own = [set(t.must.split()) for t in templates]
    out = []
    for t, must in zip(templates, own):
        mine = {w for g in must for w in g.split("|")}
        others = {g for o, m in zip(templates, own) if o.family == t.family and o.licence != t.licence for g in m}
        out.append((must, {g for g in others if not mine & set(g.split("|"))}))
    return out


def wider_templates(templates) -> list[list[int]]:
    """Per template those of its family that need all it needs and more."""
    own = [set(t.must.split()) for t in templates]
    return [[j for j, o in enumerate(templates) if o.family == t.family and own[i] < own[j]]
            for i, t in enumerate(templates)]


def _rules(templates, terms):
    """(term x group membership, groups a template must hold, must not hold, anchor terms)."""
    need = required_terms(templates)
    groups = sorted(set().union(*[a | b for a, b in need]))
    member = np.zeros((len(terms), len(groups)))
    for g, group in enumerate(groups):
        for (h,) in _hashes(group.split("|")):
            member[np.searchsorted(terms, h), g] = 1.0
    must = np.array([[g in a for g in groups] for a, _ in need], dtype=float)
    never = np.array([[g in b for g in groups] for _, b in need], dtype=float)
    anchor = np.zeros(len(terms), dtype=bool)
    for t in templates:
        anchor |= member[:, groups.index(t.must.split()[0])] > 0
    return member, must, never, anchor


def _lookup(terms, h):
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def _frequencies(shared):
    def run(batches):
        terms = shared.value
        df, n = np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            for lo, hi, buf, off in text_blocks(batch.column(0)):
                h, _, _, first = words(buf, off, ALNUM)
                v = _lookup(terms, h)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                pair = np.unique(doc[v >= 0] * len(terms) + v[v >= 0])
                df += np.bincount(pair % len(terms), minlength=len(terms))
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(terms)), -1)), pa.array(np.append(df, n))],
                                         names=["v", "df"])
    return run


def _segments(anchors, doc_of, first_line, window):
    """Runs of lines, inside one document, that every window with an anchor line lies in."""
    lo = np.maximum(anchors - (window - 1), first_line[doc_of])
    hi = np.minimum(anchors + window, first_line[doc_of + 1])
    new = np.concatenate(([True], (lo[1:] > hi[:-1]) | (doc_of[1:] != doc_of[:-1])))
    at = np.flatnonzero(new)
    return zip(doc_of[at].tolist(), lo[at].tolist(), np.append(hi[at[1:] - 1], hi[-1]).tolist())


def _windows(line, v, lo, hi, model, window, best):
    """Raise ``best`` (score, first line and lines per template) by the windows of lines
    ``lo`` to ``hi``. Of equal scores the first line and then the lower window counts."""
    idf, rare, unit, member, must, never = model
    score, first, height = best
    size = must.sum(axis=1)
    for start in range(lo, hi, BLOCK):
        stop = min(start + BLOCK, hi)
        end = min(stop + window - 1, hi)
        a, b = np.searchsorted(line, [start, end])
        ln, t = line[a:b] - start, v[a:b]
        count = np.zeros((end - start + 1, len(idf)))
        known = t >= 0
        np.add.at(count, (ln[known] + 1, t[known]), 1.0)
        other = np.bincount(ln[~known] + 1, minlength=end - start + 1).astype(float)
        count, other = count.cumsum(axis=0), other.cumsum()
        groups = count @ member
        for n in range(1, min(window, end - start) + 1):
            i = np.arange(min(stop - start, end - start - n + 1))
            held = ((groups[i + n] - groups[i]) > 0).astype(float)
            fits = (held @ must.T == size) & (held @ never.T == 0)
            i = i[fits.any(axis=1)]
            if not len(i):
                continue
            w = (count[i + n] - count[i]) * idf
            norm = np.sqrt((w * w).sum(axis=1) + (other[i + n] - other[i]) * rare * rare)
            cos = np.where(fits[i], np.round((w @ unit) / norm[:, None], 9), 0.0)
            at = cos.argmax(axis=0)
            top, where = cos.max(axis=0), start + i[at]
            better = (top > score) | ((top == score) & (top > 0) & (where < first))
            score[better], first[better], height[better] = top[better], where[better], n


def choose(score, first, height, wider) -> int:
    """The template of a file, or -1: the best score (then first line, lower window, first
    template). Where the best window is part of a longer text, as two clauses are of
    three, a template that needs more (``wider``) counts if it reaches ``THRESHOLD`` and
    the best score less ``NEAR`` on a window that overlaps."""
    def lead(among):
        return min(among, key=lambda t: (-score[t], first[t], height[t], t), default=-1)
    best = lead([t for t in range(len(score)) if score[t] >= THRESHOLD])
    while best >= 0:
        more = lead([t for t in wider[best] if score[t] >= max(THRESHOLD, score[best] - NEAR)
                     and first[t] < first[best] + height[best] and first[best] < first[t] + height[t]])
        if more < 0:
            break
        best = more
    return best


def _best(shared):
    def run(batches):
        terms, anchor, model, names, wider, window = shared.value
        for batch in batches:
            for lo, hi, buf, off in text_blocks(batch.column(0)):
                h, start, _, first = words(buf, off, ALNUM)
                v = _lookup(terms, h)
                # an empty text has a line too, so that every document has a first line
                begin = np.sort(np.concatenate((off[:-1], np.setdiff1d(np.flatnonzero(buf == 10) + 1, off))))
                line = np.searchsorted(begin, start, side="right") - 1
                first_line = np.append(np.searchsorted(begin, off[:-1], side="right") - 1, len(begin))
                best, name = np.zeros(hi - lo), [None] * (hi - lo)
                where, height = np.full(hi - lo, -1), np.zeros(hi - lo, dtype=np.int64)
                hit = v >= 0
                hit[hit] = anchor[v[hit]]
                anchors, at = np.unique(line[hit], return_index=True)
                if len(anchors):
                    doc_of = np.searchsorted(off[1:], start[hit][at], side="right")
                    found = {}
                    for d, a, b in _segments(anchors, doc_of, first_line, window):
                        empty = np.zeros(len(names)), np.full(len(names), -1), np.zeros(len(names), dtype=np.int64)
                        _windows(line, v, a, b, model, window, found.setdefault(d, empty))
                    for d, (score, i, n) in found.items():
                        t = choose(score, i, n, wider)
                        if t >= 0:
                            best[d], name[d], where[d], height[d] = min(score[t], 1.0), names[t], i[t] - first_line[d], n[t]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in batch.columns[1:]]
                    + [pa.array(name, pa.string()), pa.array(best), pa.array(where.astype(np.int64)), pa.array(height)],
                    names=[*batch.schema.names[1:], "__licence", "__score", "__line", "__lines"])
    return run


def own_licences(files: DataFrame, keep: list[str], text_col: str = "text", templates=TEMPLATES,
                 window: int = WINDOW) -> DataFrame:
    """Columns ``keep`` with own_licence, own_score (0 without one), own_line (from 0, -1
    without one) and own_lines (height of the window) of every file.

    An SPDX tag counts before any template, with its whole expression and score 1; of
    several the first. Null or empty texts have no licence. Scores are compared at nine
    decimals (``choose`` says how ties end).
    Texts of any length are read whole, ``BLOCK`` window starts at a time. ``keep`` may
    not hold names that begin with two underscores.
    """
    spark = files.sparkSession
    prepare(spark)
    terms, tf = _vocabulary(templates)
    member, must, never, anchor = _rules(templates, terms)
    sc = spark.sparkContext
    body = F.col(text_col).cast("string")
    text = files.select(body.alias("__text"), F.nullif(F.regexp_extract(body, SPDX_TAG, 1), F.lit("")).alias("__tag"), *keep)
    tag_line = F.when(F.col("__tag").isNotNull(), F.expr(
        "length(regexp_replace(substring_index(__text, 'SPDX-License-Identifier:', 1), '[^\\n]', ''))"))
    counts = {r["v"]: r["df"] for r in text.select("__text")
              .mapInArrow(_frequencies(sc.broadcast(terms)), "v long, df long")
              .groupBy("v").agg(F.sum("df").alias("df")).collect()}     # one row per template term
    n = counts.get(-1, 0)
    idf = np.log((n + 1.0) / (np.array([counts.get(i, 0) for i in range(len(terms))]) + 1.0)) + 1.0
    unit = tf * idf[:, None]
    unit = unit / np.sqrt((unit * unit).sum(axis=0))
    rare = float(np.log((n + 1.0) / 2.0) + 1.0)
    shared = sc.broadcast((terms, anchor, (idf, rare, unit, member, must, never), [t.licence for t in templates],
                           wider_templates(templates), window))
    text = text.select("__text", "__tag", tag_line.cast("long").alias("__tag_line"), *keep)
    fields = ", ".join(f"`{c}` {t}" for c, t in text.dtypes[1:])
    out = text.mapInArrow(_best(shared), f"{fields}, __licence string, __score double, __line long, __lines long")
    tagged = F.col("__tag").isNotNull()
    return out.select(*keep, F.coalesce("__tag", "__licence").alias("own_licence"),
                      F.when(tagged, F.lit(1.0)).otherwise(F.col("__score")).alias("own_score"),
                      F.when(tagged, F.col("__tag_line")).otherwise(F.col("__line")).alias("own_line"),
                      F.when(tagged, F.lit(1).cast("long")).otherwise(F.col("__lines")).alias("own_lines"))


def inherit(files: DataFrame, declares: Column, path: str = "path") -> DataFrame:
    """Add licence and licence_from: a file's own licence, or that declared in its
    nearest ancestor directory by a file for which ``declares`` holds (of several in
    one directory, the one with the first path), or null. ``path`` uses '/'; a null
    path inherits nothing."""
    up = F.expr(f"""transform(sequence(0, greatest(size(split({path}, '/')) - 1, 0)),
                              d -> array_join(slice(split({path}, '/'), 1, d), '/'))""")
    parent = F.expr(f"array_join(slice(split({path}, '/'), 1, size(split({path}, '/')) - 1), '/')")
    dirs = store(files.where(declares & F.col("own_licence").isNotNull() & F.col(path).isNotNull())
                 .groupBy(parent.alias("dir")).agg(F.min(F.struct(F.col(path), F.col("own_licence"))).alias("x"))
                 .select("dir", F.col("x.own_licence").alias("found")), "op10-directories")
    # every directory that holds files, once, with its nearest declaring ancestor
    places = files.where(F.col(path).isNotNull() & F.col("own_licence").isNull()) \
        .select(parent.alias("place"), up.alias("up")).distinct()
    near = (places.select("place", F.posexplode("up").alias("depth", "dir")).join(dirs, "dir")
            .groupBy("place").agg(F.max_by(F.struct("dir", "found"), "depth").alias("x"))
            .select("place", F.col("x.found").alias("found"), F.col("x.dir").alias("from")))
    near = store(near, "op10-nearest")
    out = files.join(near, (parent == F.col("place")) & F.col("own_licence").isNull(), "left")
    return out.select(*files.columns, F.coalesce("own_licence", "found").alias("licence"),
                      F.when(F.col("own_licence").isNotNull(), F.col(path)).otherwise(F.col("from"))
                      .alias("licence_from"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_licence, own_score, own_line, own_lines, licence, licence_from:
    one row per document. A document lies at source/lang/<doc_id div 1000>/doc_id (null parts
    are empty names, a null id gives no path); those with an id divisible by 1000
    declare the licence of their directory. Rows that repeat are judged alike; other
    columns are not read; an empty table gives no rows.
    """
    number = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")),
                       F.floor(number / 1000).cast("string"), number.cast("string"))
    files = docs.select("text", number.alias("doc_id"), F.when(number.isNotNull(), path).alias("path"))
    own = store(own_licences(files, ["doc_id", "path"]), "op10-own")
    return inherit(own, F.pmod("doc_id", F.lit(1000)) == 0)
