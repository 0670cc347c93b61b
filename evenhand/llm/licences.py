"""6 License scans by conditional compression.

Candidate blocks are the sentences that hold a word of licence language, and each line that does, with the line before it and as
many after it as the longest template may fill. Each block is compressed
alone and once with every template's wording as zstandard raw dictionary; templates rank by the share of bytes that their
dictionary saves, as text that is said in the template's own words needs hardly any bytes beside it. Every template whose key
words (names and version numbers) stand in the block as they are is compared word by word around them: it is confirmed when
the differing words are at most one or ``tolerance`` of its words, and the one with the most agreeing words, less the
differing ones, is the finding. What the block holds before and behind it is searched again until nothing more is confirmed.

Defined results: null and empty texts and texts without licence language have no findings; findings of one text don't overlap, the
one with more agreeing words, less the differing ones, stays; equal savings rank by template name; repeated rows give equal findings; a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from evenhand.llm.common import slices

# Wordings of public licences (fixed values); the second part holds the words that must stand in a text exactly.
TEMPLATES = {
    "All rights reserved": ("All rights reserved.", "all rights reserved"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    "Apache-2.0 header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "apache 2.0"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution permitted conditions"),
    "BSD-3-Clause notice": ("Released under the 3-clause BSD License.", "3-clause bsd"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "by 4.0"),
    "CC-BY-4.0 long": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4.0 international"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "by-nc 4.0"),
    "CC-BY-NC-4.0 long": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "attribution-noncommercial 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "by-sa 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    "GPL header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "free gnu general"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "distribute fee granted"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "lesser 3"),
    "MIT": ("Released under the MIT License.", "mit"),
    "MIT permission": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "granted free charge restriction"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "unencumbered domain"),
}
# Short forms, which the SQL does not look for.
SHORT_FORMS = {
    **{f"{x} SPDX": (f"SPDX-License-Identifier: {x}", f"spdx-license-identifier {x.lower()}") for x in (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense")},
    "Apache-2.0 short": ("Apache License 2.0", "apache license 2.0"),
    "CC-BY-4.0 short": ("CC BY 4.0", "cc by 4.0"),
    "CC-BY-NC-4.0 short": ("CC BY-NC 4.0", "cc by-nc 4.0"),
    "CC-BY-SA-4.0 short": ("CC BY-SA 4.0", "cc by-sa 4.0"),
    "MIT short": ("MIT License", "mit license"),
}
# Parts of words by which licence language is found.
LANGUAGE = ["licen", "copyright", "rights reserved", "permission", "redistribut", "warrant", "public domain", "creative commons", "waived", "cc by", "cc0", "spdx"]
WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?](?![\s]|$))+[.!?]*")


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), *m.span()) for m in WORD.finditer(text)]


def blocks(text: str, reach: int) -> Iterator[tuple[int, int]]:
    """Offsets of candidate blocks; ``reach``: words of the longest template."""
    low = text.lower() if len(text.lower()) == len(text) else text
    if not any(w in low for w in LANGUAGE):
        return
    for m in SENTENCE.finditer(text):
        if any(w in low[m.start() : m.end()] for w in LANGUAGE):
            yield m.span()
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)]
    for i, (a, b) in enumerate(lines):
        if len(lines) > 1 and any(w in low[a:b] for w in LANGUAGE):
            j, n = i, text.count(" ", a, b) + 1
            while j + 1 < len(lines) and n < reach:
                j += 1
                n += text.count(" ", *lines[j]) + 1
            if j > i or i:
                yield lines[max(0, i - 1)][0], lines[j][1]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, str]], tolerance: float):
        self.tolerance = tolerance
        self.alone = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False)
        self.with_template, self.words, self.keys = {}, {}, {}
        for name, (wording, keys) in templates.items():
            raw = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template[name] = zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.words[name] = [w for w, _, _ in words_of(wording)]
            self.keys[name] = set(keys.split())
        self.reach = max(map(len, self.words.values()))

    def ranked(self, block: str, names: list[str]) -> list[tuple[float, str]]:
        """The named templates by the share of the block's compressed size that they save."""
        raw = " ".join(block.lower().split()).encode("utf-8", "replace")
        plain = len(self.alone.compress(raw))
        return sorted(((1 - len(self.with_template[name].compress(raw)) / plain, name) for name in names), key=lambda x: (-x[0], x[1]))

    def differences(self, words: list[tuple[str, int, int]], name: str) -> tuple[int, int, int, int] | None:
        """(differing words, agreeing words, start, stop) of the place where the block says the template; None without its key words."""
        own = self.words[name]
        match = SequenceMatcher(None, [w for w, _, _ in words], own, autojunk=False)
        same = [m for m in match.get_matching_blocks() if m.size]
        for at, step in ((0, 1), (-1, -1)):  # single words that agree far from the rest are chance
            while len(same) > 1 and same[at].size < abs((same[at + step].a - same[at].a) - (same[at + step].b - same[at].b)):
                same.pop(at)
        if not same:
            return None
        first, last = same[0].a, same[-1].a + same[-1].size
        agree = sum(m.size for m in same)
        here = {words[i][0] for m in same for i in range(m.a, m.a + m.size)}
        if not self.keys[name] <= here:
            return None
        return (last - first - agree) + (len(own) - agree), agree, words[first][1], words[last - 1][2]

    def best(self, block: str, words: list[tuple[str, int, int]]) -> tuple | None:
        """The confirmed template with the most agreeing words, less the differing ones, in these words of a block."""
        here: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            here.setdefault(w[0], []).append(i)
        names = [name for name, keys in self.keys.items() if all(k in here for k in keys)]
        best = None
        for saved, name in self.ranked(block, names) if names else ():
            n = len(self.words[name])
            most = max(1, self.tolerance * n)
            near = n + int(most)
            for i in here[min(sorted(self.keys[name]), key=lambda k: len(here[k]))]:
                got = self.differences(words[max(0, i - near) : i + near + 1], name)
                if got and got[0] <= most and (best is None or (-got[1] + got[0], -saved) < best[0]):
                    best = ((-got[1] + got[0], -saved), name, saved, got)
        return best

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(start, stop, licence, saved share, differing words) of the findings in a text."""
        found = []
        for a, b in blocks(text, self.reach) if text else ():
            todo = [words_of(text[a:b])]
            while todo:
                words = todo.pop()
                if best := self.best(text[a:b], words):
                    _, name, saved, (differ, agree, start, stop) = best
                    found.append((agree - differ, a + start, a + stop, name, saved, differ))
                    todo += [[w for w in words if w[2] <= start], [w for w in words if w[1] >= stop]]
        kept: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
            if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
                kept.append(f)
        return [(s, e, name, saved, differ) for _, s, e, name, saved, differ in sorted(kept, key=lambda f: f[1])]


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES | SHORT_FORMS, tolerance: float = 0.15) -> DataFrame:
    """doc_id, start, stop (code points), licence, saved (share of bytes) and differing words of every confirmed finding."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        scanner = Scanner(templates, tolerance)
        for batch in slices(batches, "text"):
            out = [(i, *f) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for f in scanner.scan(t)]
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "start", "stop", "licence", "saved", "differing"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, start int, stop int, licence string, saved double, differing int")


def sql(templates: dict[str, tuple[str, str]] = TEMPLATES) -> str:
    """Findings of the exact wordings in SQL; the same rows where texts hold wordings whole and unchanged."""
    rows = ", ".join("('" + name.replace("'", "''") + "', '" + wording.rstrip(".:").replace("'", "''") + "')" for name, (wording, _) in templates.items())
    return f"""with t(licence, w) as (values {rows}),
 p as (select doc_id, licence, w, string_split(text, w) ps from documents, t where contains(text, w)),
 o as (select doc_id, licence, w, unnest(ps) part, unnest(range(len(ps))) i, len(ps) n from p),
 s as (select *, cast(sum(length(part)) over (partition by doc_id, licence order by i) as bigint) + i * length(w) s0 from o)
select doc_id, cast(s0 as int) as start, cast(s0 + length(w) as int) as stop, licence, cast(0 as int) as differing from s where i < n - 1"""
