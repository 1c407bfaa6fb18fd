"""License scans by conditional compression.

Candidate blocks are the sentences of paragraphs (wrapped lines are joined) that hold a
cue such as "licen" or "rights reserved".  A block is compressed once alone and once with
each template as a raw zstandard dictionary; templates are ranked by the reduction.  In
that order they are confirmed by wording: the template is aligned word by word to the
window of the block that quotes it, few words may differ, none of them a name or number of
the template, and the window itself must get smaller by ``MIN_REDUCTION``.  The first
confirmed template takes its window; those after it may be confirmed in what is left, so a
block can name several licenses.  No template is left out of the ranking or cut from it.

Defined results: a null or empty text has no license; equal blocks get equal answers;
equal reductions go to the alphabetically first template; adjacent blocks of one license
are one finding; a block with one license is its place, several have their windows; repeated
rows get equal findings; an empty table gives an empty table.  Places are code points, end
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short notices and the wording that tells a license; a parameter of ``find``.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "all-rights-reserved": ["All rights reserved."],
}
for _name in TEMPLATES:
    if _name != "all-rights-reserved":
        TEMPLATES[_name].append(f"SPDX-License-Identifier: {_name}")
CUES = ("licen", "rights reserved", "redistribut", "permission is", "permission to use", "neither the name", "public license", "spdx")
#: The reduction a template must reach.
MIN_REDUCTION = 0.25
#: Differing words inside the quoted wording per word of the template.
MAX_DIFFERENCE = 0.15
#: Templates of so many words may be quoted in part, and how many words a quote has.
LONG = 15
QUOTED = 8
#: Characters of different blocks a task remembers the licenses of.
KNOWN_BYTES = 32 << 20
#: Stands for words that belong to a license found already.
_TAKEN = "\0"
FINDING = "array<struct<license:string,start:int,end:int,reduction:double,missing:int,extra:int>>"

_BLOCK = re.compile(r"(?s).+?(?:(?<!\b[vV])[.!?](?=\s|\Z)|\Z)")
_LINE = re.compile(r"[^\n]+")
_ALL = re.compile(r"(?s).+")
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([^\n]+)")
_SPDX_NAME = re.compile(r"(?i)\b(?!(?:and|or|with)\b)[A-Z0-9][A-Z0-9.+-]*")
# What the two-clause text has in common with the three-clause one, and what it lacks.
_TWO_CLAUSES = ("redistributions of source code must retain", "redistributions in binary form must reproduce")
_THIRD_CLAUSE = "neither the name"
#: Words that make another license of the one they stand in.
_QUALIFIERS = frozenset(("lesser", "affero", "library"))
_WORD = re.compile(r"[^\W_]+")
# words that name no license; all others must agree
_COMMON = frozenset("a an the is are this work file software program under licensed released license version of and or to in by v".split())


def normal(text: str) -> str:
    return " ".join(text.lower().split())


class Scanner:
    """Templates with their compressors, one dictionary each."""

    def __init__(self, templates: dict[str, list[str]]):
        options = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "compression_level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        parameters = lambda: zstandard.ZstdCompressionParameters(**options)
        self.plain = zstandard.ZstdCompressor(compression_params=parameters())
        self.templates = []
        for name in sorted(templates):
            for text in templates[name]:
                raw = zstandard.ZstdCompressionDict(normal(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, _WORD.findall(normal(text)), zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters())))
        self.whole = {tuple(words) for _, words, _ in self.templates}
        self.known: dict[str, list[tuple]] = {}
        self.known_size = 0

    def _ranked(self, block: str) -> list[tuple[float, str, list[str], zstandard.ZstdCompressor]]:
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        found = [(1 - len(packer.compress(data)) / alone, name, words, packer) for name, words, packer in self.templates]
        return sorted(found, key=lambda f: (-f[0], f[1]))

    def rank(self, block: str) -> list[tuple[float, str, list[str]]]:
        """(reduction, license, words) of the templates, best first."""
        return [found[:3] for found in self._ranked(block)]

    def classify(self, block: str) -> tuple[str, float, int, int] | None:
        """(license, reduction, missing, extra words) of the first license of a normalised block."""
        found = self.licenses(block)
        return found[0][:4] if found else None

    def licenses(self, block: str) -> list[tuple[str, float, int, int, int, int]]:
        """(license, reduction, missing, extra words, first and last word) by rank."""
        if block not in self.known:
            if self.known_size > KNOWN_BYTES:
                self.known, self.known_size = {}, 0
            self.known[block] = self._classify(block)
            self.known_size += len(block)
        return self.known[block]

    def _classify(self, block: str) -> list[tuple[str, float, int, int, int, int]]:
        places = list(_WORD.finditer(block))
        words = [m[0] for m in places]
        out: list[tuple[str, float, int, int, int, int]] = []
        for whole, name, template, packer in self._ranked(block):
            if whole <= 0:
                break  # the dictionary is of no use, nor are those after it
            if any(name == o[0] for o in out):
                continue
            found = self._confirm(template, words)
            if found is None:
                continue
            first, last, missing, inside = found
            data = block[places[first].start() : places[last].end()].encode("utf-8", "surrogatepass")
            reduction = 1 - len(packer.compress(data)) / len(self.plain.compress(data))
            if reduction < MIN_REDUCTION:
                continue
            out.append((name, reduction, len(missing), len(inside) + len(places) - (last - first + 1), first, last))
            words[first : last + 1] = [_TAKEN] * (last - first + 1)
        return out

    def _confirm(self, template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """The window that quotes a template, if its wording is the template's."""
        if len(template) < 3 and len(words) > len(template):
            return None  # a title is a block of its own
        found = align(template, words)
        if found is None:
            return None
        first, last, missing, inside, agreed = found
        if len(missing) + len(inside) > MAX_DIFFERENCE * len(template):
            return None
        changed = [w for w in (*missing, *inside) if w not in _COMMON]
        if changed and len(template) < LONG or not agreed.issuperset(w for w in template if w[0].isdigit()) or _QUALIFIERS.intersection(inside):
            return None
        return first, last, missing, inside

    def paragraphs(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of adjacent lines that hold a word."""
        start, end, at = None, 0, 0
        for line in text.split("\n"):
            if _WORD.search(line):
                start = at if start is None else start
                end = at + len(line)
            elif start is not None:
                yield start, end
                start = None
            at += len(line) + 1
        if start is not None:
            yield start, end

    def blocks(self, text: str) -> Iterator[re.Match]:
        """Sentences of paragraphs; a line that is a whole notice is a block of its own."""
        for paragraph in self.paragraphs(text):
            for sentence in _BLOCK.finditer(text, *paragraph):
                start = sentence.start()
                for line in _LINE.finditer(text, *sentence.span()):
                    if "\n" in sentence[0] and (_SPDX.search(line[0]) or tuple(_WORD.findall(normal(line[0]))) in self.whole):
                        if start < line.start():
                            yield _ALL.match(text, start, line.start())
                        yield line
                        start = line.end()
                if start < sentence.end():
                    yield _ALL.match(text, start, sentence.end())

    def _named(self, block: re.Match) -> list[tuple[str, float, int, int, int, int]] | None:
        """(license, reduction, missing, extra, start, end) of an expression of identifiers."""
        line = _SPDX.search(block[0])
        if line is None:
            return None
        names = list(_SPDX_NAME.finditer(line[1]))
        if len(names) < 2:
            return None
        out = []
        for m in names:
            found = self.licenses(normal(f"SPDX-License-Identifier: {m[0]}"))
            if found:
                at = block.start() + line.start(1)
                out.append((*found[0][:4], at + m.start(), at + m.end()))
        return out

    def scan(self, text: str | None) -> list[dict]:
        lower = (text or "").lower()
        if not any(cue in lower for cue in CUES):
            return []
        out: list[dict] = []
        adjacent = False
        for m in self.blocks(text):
            block = normal(m[0])
            if not block:
                continue
            found = self.licenses(block) if any(cue in block for cue in CUES) else []
            named = self._named(m) if found else None
            if not found:
                adjacent = False
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end = m.start() + len(m[0].rstrip())
            parts = [(*found[0][:4], start, end)] if named is None else named
            if named is None and len(found) > 1:
                words = list(_WORD.finditer(m[0]))
                exact = len(words) == len(_WORD.findall(block))  # making letters small may split a word
                parts = [(*f[:4], m.start() + words[f[4]].start(), m.start() + words[f[5]].end()) if exact else (*f[:4], start, end) for f in found]
                parts.sort(key=lambda p: p[4:])
            for name, reduction, missing, extra, start, end in parts:
                if adjacent and out[-1]["license"] == name and len(parts) == 1:
                    last = out[-1]
                    last.update(end=end, reduction=max(last["reduction"], reduction), missing=last["missing"] + missing, extra=last["extra"] + extra)
                else:
                    out.append({"license": name, "start": start, "end": end, "reduction": reduction, "missing": missing, "extra": extra})
            adjacent = True
        if any(f["license"] == "BSD-3-Clause" for f in out):
            whole = normal(re.sub(r"[^\w\n ]+", " ", lower))
            if all(clause in whole for clause in _TWO_CLAUSES) and _THIRD_CLAUSE not in whole:
                for finding in out:
                    if finding["license"] == "BSD-3-Clause":
                        finding["license"] = "BSD-2-Clause"
        return out


def align(template: list[str], words: list[str]) -> tuple[int, int, list[str], list[str], set[str]] | None:
    """First and last word of the window that quotes a template, words missing from it,
    words inserted in it, and the words that agree.

    The window lies around the longest run of agreeing words.  A block may quote part of
    a long template: what lies before its first and after its last agreeing word is not
    missing then.  Short templates must be quoted whole.
    """
    matcher = SequenceMatcher(None, template, words, autojunk=False)
    run = matcher.find_longest_match()
    if not run.size:
        return None
    slack = int(MAX_DIFFERENCE * len(template))
    low = max(0, run.b - run.a - slack)
    part = words[low : run.b - run.a + len(template) + slack]
    runs = [r for r in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if r.size]
    if sum(r.size for r in runs) < min(QUOTED, len(template)):
        return None
    first, last = (runs[0].a, runs[-1].a + runs[-1].size) if len(template) >= LONG else (0, len(template))
    agreed = {r.a + k for r in runs for k in range(r.size)}
    used = {r.b + k for r in runs for k in range(r.size)}
    missing = [template[k] for k in range(first, last) if k not in agreed]
    inside = [part[k] for k in range(min(used), max(used)) if k not in used]
    return low + min(used), low + max(used), missing, inside, {template[k] for k in agreed}


def find(text: Column, templates: dict[str, list[str]] = TEMPLATES) -> Column:
    """Findings of a text column, in order of their places."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("reduction", pa.float64()), ("missing", pa.int32()), ("extra", pa.int32())]))

    @F.arrow_udf(FINDING)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates)
        for batch in batches:
            yield pa.array([scanner.scan(t) for t in batch.to_pylist()], kind)

    return scan(text)
