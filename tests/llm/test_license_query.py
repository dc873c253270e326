"""Refused and chosen licenses, several tags, and the registered query against plain Python."""

import re

import pytest

from casekit.llm import licenses
from casekit.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index():
    return licenses.Index(licenses.ALL, licenses.NEED, licenses.BARRED)


@pytest.mark.parametrize("text,name", [
    ("This is not licensed under the MIT License.", None), ("It is no longer released under the MIT License.\nMore.", None),
    ("intro words here, not licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("If a copy of the license was not distributed with this file, see below.\nReleased under the MIT License.", "MIT"),
    ("Dual licensed under MIT and Apache License, Version 2.0.", "MIT OR Apache-2.0"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0 OR MIT"),
    ("This code is dual-licensed under the GPL v2 and the MIT license.", "GPL-2.0 OR MIT"),
    ("This was never dual licensed under MIT and Apache.", None), ("Dual licensed under MIT.", None),
    ("// SPDX-License-Identifier: MIT\ncode\n// SPDX-License-Identifier: Apache-2.0 OR GPL-2.0\n// SPDX-License-Identifier: MIT", "MIT AND (Apache-2.0 OR GPL-2.0)")])
def test_refused_chosen_and_several(index, text, name):
    got = index.own(text)
    assert got[0] == name or name is None and got[0] is None, got


def test_query_matches_plain_python(spark, index):
    files = {(r.doc_id, r.path): r.text for r in Q.files_from_documents(spark, SF).collect()}
    own = {k: index.own(t or "") for k, t in files.items()}
    grants = {}
    for (_, path), (name, c, _) in sorted(own.items(), key=lambda x: (-x[1][1], x[0][1])):
        folder, file = path.rpartition("/")[::2]
        if name and re.match(r"(?i)(licen[sc]e|copying|notice)([._-].*)?$", file):
            grants.setdefault(folder, name)
    for r in Q.op10_license_scan(spark, SF).collect():
        name, c, line = own[r.doc_id, r.path]
        assert (r.own_license, r.cosine, r.line) == (name, pytest.approx(c), line)
        folder, by = r.path.rpartition("/")[0], "own" if name else None
        while name is None and folder is not None:
            if folder in grants:
                name, by = grants[folder], folder
            folder = folder.rpartition("/")[0] if folder else None
        assert (r.license, r.granted_by) == (name, by)
    assert sum(v[0] is not None for v in own.values()) >= 3
