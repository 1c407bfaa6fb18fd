"""Ranking before confirming, several licenses in a block, and texts of licenses."""

import time

import pytest

from codegauge.llm import licenses

BSD = """Copyright (c) 2020, Jane Doe
All of it.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


@pytest.mark.parametrize("text, names", [
    ("This project is licensed under the MIT license.", ["MIT"]),
    ("MIT License\n\nCopyright (c) 2020 Jane Doe", ["MIT"]),
    ("The MIT License (MIT)", ["MIT"]),
    ("He read the MIT license twice.", []),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\n"
     "version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD + THIRD, ["BSD-3-Clause", "BSD-3-Clause"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("// SPDX-License-Identifier: (GPL-2.0 AND BSD-2-Clause) OR ISC\nimport os", ["GPL-2.0", "BSD-2-Clause", "ISC"]),
    ("Released under the MIT License or licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://x", ["EPL-2.0"]),
])
def test_texts_of_licenses(scanner, text, names):
    assert [f["license"] for f in scanner.scan(text)] == names


def test_several_licenses_have_their_windows(scanner):
    text = "Read on: Released under the MIT License or licensed under the Apache License, Version 2.0, at any choice."
    found = scanner.scan(text)
    assert [text[f["start"] : f["end"]] for f in found] == ["Released under the MIT License", "licensed under the Apache License, Version 2.0"]


def test_templates_are_confirmed_in_the_order_of_their_reductions(scanner, monkeypatch):
    """The query's answer goes through the ranking: what it puts first is confirmed first."""
    block = licenses.normal("This work is licensed under the GNU General Public License, version 2.")
    asked = []
    confirm = licenses.Scanner._confirm
    monkeypatch.setattr(licenses.Scanner, "_confirm", lambda self, template, words: asked.append(template) or confirm(self, template, words))
    fresh = licenses.Scanner(licenses.TEMPLATES)
    assert fresh.classify(block)[0] == "GPL-2.0"
    ranked = [words for reduction, name, words in fresh.rank(block) if reduction > 0]
    assert asked and asked == [words for words in ranked if words in asked]
    # without a reduction nothing is confirmed
    monkeypatch.setattr(licenses.Scanner, "_ranked", lambda self, block: [(0.0, *t) for t in self.templates])
    assert licenses.Scanner(licenses.TEMPLATES).classify(block) is None


@pytest.mark.parametrize("text", ["licen\n" + "#" * 200_000, "licen " * 40_000, "licen\n" + "#\n" * 100_000, "a. licen " * 30_000])
def test_long_texts_take_linear_time(scanner, text):
    begin = time.perf_counter()
    assert scanner.scan(text) == []
    assert time.perf_counter() - begin < 5
