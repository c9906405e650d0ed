"""Licences of pages: TF-IDF cosine to templates, then inheritance by path.

Statements around cue words, links to licences and whole licence files are compared with
short templates as sparse TF-IDF vectors; the frequencies of all terms, hashed,
come from all windows.  A file without a licence of its own takes that of its nearest
ancestor directory, where a directory's licence is declared by a licence file
in it or by its index page.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Scratch, column, small

# What licence statements say, by licence.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "Creative Commons Zero CC0 1.0 Universal public domain dedication"],
    "Proprietary": ["All rights reserved", "Proprietary and confidential. All rights reserved. Unauthorized copying is prohibited"],
}
_CUE = re.compile(r"licen[sc]ed?\b|\breleased\s+under\b|\ball\s+rights\s+reserved\b|\bpublic\s+domain\b|\bpermission\s+is\s+hereby\b|\bredistribut", re.I)
_OPEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = re.compile(r"</(?:script|style)\s*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FILE = r"(?i)^(un)?licen[sc]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"
#: Tags within a sentence, line breaks, links and the ends of sentences.
_INLINE = re.compile(r"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)\b|<!--", re.I)
_BREAK = re.compile(r"</?br\b", re.I)
_LINK = re.compile(r"<(?:a|link|area)\s[^<>]*>", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_REL = re.compile(r"""\brel\s*=\s*(?:"[^"]*\blicense\b|'[^']*\blicense\b|license\b)""", re.I)
_CC = re.compile(r"creativecommons\.org/(?:licenses|publicdomain)/", re.I)
_ADDRESS = {
    name: re.compile(at, re.I)
    for name, at in {
        "MIT": r"/mit(?:-license|\.\w+)?/?$", "Apache-2.0": r"apache.*2\.0", "LGPL-3.0": r"\blgpl-3", "AGPL-3.0": r"\bagpl-3", "GPL-3.0": r"\bgpl-3", "GPL-2.0": r"\bgpl-2",
        "BSD-3-Clause": r"/bsd-3-clause", "MPL-2.0": r"\bmpl[/-]2\.0", "CC-BY-4.0": r"creativecommons\.org/licenses/by/4\.0", "CC-BY-SA-4.0": r"creativecommons\.org/licenses/by-sa/4\.0",
        "CC-BY-NC-4.0": r"creativecommons\.org/licenses/by-nc/4\.0", "CC0-1.0": r"creativecommons\.org/publicdomain/zero/1\.0",
    }.items()
}
_END = re.compile(r"(?<=[.!?])\s+(?=[^\W\da-z])")
#: Characters before and after a cue that are compared alone, where its whole sentence is like no template.
BEFORE, AFTER = 60, 160
#: Terms of the runs that are compared beside a whole text, and places of the hashed terms' counts.
SPANS, HASHED = (8, 16, 32), 1 << 18


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


def linked(url: str) -> str | None:
    """The licence that an address names, if it has templates."""
    return next((name for name, at in _ADDRESS.items() if at.search(url)), None)


def without_scripts(text: str) -> str:
    """The page with a tag for each script or style; one that never closes stays as text."""
    out, at = [], 0
    while m := _OPEN.search(text, at):
        end = _CLOSE.search(text, m.end())
        if not end:
            break
        out += [text[at : m.start()], "<p>"]
        at = end.end()
    return "".join([*out, text[at:]])


def windows(text: str | None, whole: bool) -> list[list[str]]:
    """Licence statements of a page, each with the texts that may stand for it.

    A statement is a run of sentences with cues in one paragraph, across line
    breaks and inline tags; the run and each sentence stand for it, and in the
    last place, where these say nothing, the words near each cue.  A link to a
    licence stands for the licence's first template.  A licence file is one statement, its whole text.
    """
    text = (text or "").replace("\0", " ").replace("\1", " ").replace("\2", " ")
    text = without_scripts(text)
    plain = html.unescape(_TAG.sub(lambda m: "" if _INLINE.match(m[0]) else "\n" if _BREAK.match(m[0]) else "\n\n", text))
    if whole:
        return [[plain, ""]]
    out = []
    for m in _LINK.finditer(text):
        url = _HREF.search(m[0])
        if url and (_REL.search(m[0]) or _CC.search(m[0])):
            name = linked(html.unescape(url[1].strip("\"'")))
            out += [[TEMPLATES[name][0], ""]] if name else []
    if not _CUE.search(plain):
        return out
    for paragraph in re.split(r"\n\s*\n", plain):
        if not _CUE.search(paragraph):
            continue
        runs: list[list[str]] = [[]]
        for sentence in _END.split(paragraph):
            if _CUE.search(sentence):
                runs[-1].append(sentence)
            elif runs[-1]:
                runs.append([])
        for run in filter(None, runs):
            near = [x for sentence in run for x in close(sentence)]
            out.append(["\1".join([" ".join(run), *run] if len(run) > 1 else run), "\1".join(x for x in near if x not in run)])
    return out


def close(plain: str) -> list[str]:
    """The words near each cue, within its line."""
    out, last = [], -1
    for m in _CUE.finditer(plain):
        if m.start() < last:
            continue
        lo = max(plain.rfind("\n", max(0, m.start() - BEFORE), m.start()), m.start() - BEFORE) + 1
        hi = plain.find("\n", m.end(), m.end() + AFTER)
        last = min(hi if hi >= 0 else len(plain), m.end() + AFTER)
        out.append(plain[max(lo, 0) : last])
    return out


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % HASHED


class Matcher:
    """Templates as sparse TF-IDF rows over all terms.

    ``seen`` counts the windows that hold each hashed term, of ``total``; a text
    is compared as a whole and in runs of SPANS terms, half over half, so what
    surrounds a statement does not hide it.
    """

    def __init__(self, seen: np.ndarray, total: int):
        self.idf = np.log((total + 1) / (seen + 1)) + 1
        self.names, self.rows = [], []
        for name, texts in TEMPLATES.items():
            for text in texts:
                v = self.vector(Counter(_TERM.findall(text.lower())))
                size = math.sqrt(sum(x * x for x in v.values()))
                self.names.append(name)
                self.rows.append({t: x / size for t, x in v.items()})
        self.known = {t for row in self.rows for t in row}

    def vector(self, count: Counter) -> dict[str, float]:
        return {t: (1 + math.log(n)) * self.idf[bucket(t)] for t, n in count.items()}

    def best(self, text: str) -> tuple[str | None, float]:
        """The closest template, the first of equal ones, and its cosine."""
        found = _TERM.findall(text.lower())
        spans = [found] + [found[lo : lo + n] for n in SPANS if n < len(found) for lo in range(0, len(found) - n // 2, n // 2)]
        best: tuple[str | None, float] = (None, 0.0)
        for span in spans:
            if self.known.isdisjoint(span):
                continue
            v = self.vector(Counter(span))
            size = math.sqrt(sum(x * x for x in v.values()))
            for name, row in zip(self.names, self.rows, strict=True):
                cos = sum(x * v.get(t, 0.0) for t, x in row.items()) / size
                if cos > best[1] + 1e-12:
                    best = name, cos
        return best


def path_parts(path: Column) -> Column:
    """Segments of a path or URL: host and folders, without query or fragment.

    An index page, whose path ends with a slash, ends with an empty segment.
    """
    bare = F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.split(bare, "/")


def licences(pages: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html", *, least: float = 0.5) -> DataFrame:
    """(id, licence, how, cosine, inherited_from) of each row.

    ``how`` is header, file or inherited, null with no licence.  Null texts
    have no windows, null paths no directory; repeated rows and ids are judged
    each; ties of cosine go to the first template, ties in a directory to the
    highest cosine, then the least name; empty tables give no rows; other
    columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "licences")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(column(pages, id_col).alias("id"), path_parts(column(pages, path_col).cast("string")).alias("parts"), column(pages, text_col).cast("string").alias("text"))
    own_file = F.coalesce(F.element_at("parts", -1).rlike(_FILE), F.lit(False))
    rows = rows.select("id", F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")).alias("dir"), own_file.alias("is_file"), (F.coalesce(F.element_at("parts", -1) == "", F.lit(False)) & (F.size("parts") > 1)).alias("is_index"), "text")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = ["\0".join(map("\2".join, windows(t, f))) for t, f in zip(batch["text"], batch["is_file"], strict=True)]
            yield batch.drop(columns="text").assign(found=found)

    found = scratch.table(rows.mapInPandas(gather, f"id {kind}, dir string, is_file boolean, is_index boolean, found string").withColumn("uid", F.monotonically_increasing_id()), "windows")

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, total = np.zeros(HASHED, np.int64), 0
        for batch in batches:
            for joined in batch["found"]:
                for window in re.split("[\0\1]", re.sub("\2[^\0]*", "", joined)) if joined else ():
                    total += 1
                    sums[list({bucket(t) for t in terms(window)})] += 1
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"term": np.append(-1, at), "n": np.append(total, sums[at])})

    counts, total = np.zeros(HASHED), 0
    for r in found.select("found").mapInPandas(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most HASHED rows
        if r["term"] < 0:
            total = r["n"]
        else:
            counts[r["term"]] = r["n"]

    def stands(matcher: Matcher, statement: str) -> tuple[str | None, float]:
        whole, near = (max(map(matcher.best, x.split("\1")), key=lambda b: b[1]) for x in statement.split("\2"))
        return whole if whole[1] >= least else max(whole, near, key=lambda b: b[1])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(counts, total)
        for batch in batches:
            best = [max((stands(matcher, w) for w in x.split("\0")), key=lambda b: b[1]) if x else (None, 0.0) for x in batch["found"]]
            own = [n if c >= least else None for n, c in best]
            yield batch.drop(columns="found").assign(licence=own, cosine=[c if n is not None else None for n, (_, c) in zip(own, best, strict=True)])

    judged = found.mapInPandas(match, f"id {kind}, dir string, is_file boolean, is_index boolean, uid long, licence string, cosine double")
    judged = scratch.table(judged, "judged")
    told = judged.where("licence is not null and dir is not null and (is_file or is_index)")
    dirs = told.groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), "licence")).alias("d")).select("dir", F.col("d.licence").alias("dir_licence"))
    dirs = scratch.table(dirs, "dirs")
    lone = judged.where("licence is null and dir is not null").select("uid", F.split("dir", "/").alias("parts"))
    up = lone.select("uid", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").select("uid", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
    near = up.join(small(dirs, dirs.count()), "dir").groupBy("uid").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("up"))
    out = judged.join(near, "uid", "left")
    how = F.when(F.col("licence").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("up").isNotNull(), "inherited")
    return out.select(F.col("id").alias(id_col), F.coalesce("licence", "up.dir_licence").alias("licence"), how.alias("how"), "cosine", F.col("up.dir").alias("inherited_from"))
