"""Notices inside longer sentences, wrapped over lines, and as SPDX lines."""

import pytest

from codegauge.llm import licenses

GPL = """// This program is free software; you can redistribute it and/or modify
// it under the terms of the GNU {}General Public License as published by
// the Free Software Foundation; either version {} of the License, or
// (at your option) any later version."""


@pytest.mark.parametrize("text, names", [
    ("This software is released under the MIT License.", ["MIT"]),
    ("Copyright 2021 Jane Doe, all rights reserved.", ["all-rights-reserved"]),
    ("Unless a file says otherwise, all that you find in this folder and below it is released under the MIT License.", ["MIT"]),
    (" * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed", ["MPL-2.0"]),
    (GPL.format("", 2), ["GPL-2.0"]),
    (GPL.format("", 2).replace("\n//", ""), ["GPL-2.0"]),
    (GPL.format("", 3), ["GPL-3.0"]),
    (GPL.format("", 4), []),
    (GPL.format("Lesser ", 2), []),
    (GPL.format("Affero ", 3), []),
    ("# SPDX-License-Identifier: Apache-2.0\nimport os", ["Apache-2.0"]),
    ("/* SPDX-License-Identifier: CC-BY-SA-4.0 */", ["CC-BY-SA-4.0"]),
    ("This program is free software; you can redistribute it and/or modify", []),
    ("A heading\nReleased under the MIT License.", ["MIT"]),
])
def test_notices(text, names):
    assert [f["license"] for f in licenses.Scanner(licenses.TEMPLATES).scan(text)] == names
