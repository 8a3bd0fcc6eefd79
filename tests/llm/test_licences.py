import re

from leafquery.llm.licences import HINTS, RULES, SENTENCES, scan

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

APACHE = """x = 1
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

CASES = {
    MIT: ["MIT"], APACHE: ["Apache-2.0"],
    "Text\nReleased under the MIT License.\nMore": ["MIT"],
    "a. This work is licensed under the GNU General Public License, version 3. b": ["GPL-3.0-only"],
    "All rights reserved. Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0", "all-rights-reserved"],
    "Licensed### under*** CC%%% BY-NC&&& 4.0.###": ["CC-BY-NC-4.0"],
    "Released under the MIT License.\nReleased under the MIT License.": ["MIT"],
    "licence plates are permitted, see the name of the street": [],
    "# SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"],
    "": [], "plain": [], "word " * 40000 + "\nAll rights reserved.\n": ["all-rights-reserved"],
}


def test_licences_of_texts(docs_of):
    rows = list(enumerate(CASES)) + [(99, None)]
    got = {r.row.doc_id: r for r in scan(docs_of(rows)).collect()}
    for k, (text, want) in enumerate(CASES.items()):
        assert got[k].licences == want, text[:60]
    assert got[0].sentences == ["MIT name", "Copyright", "MIT grant", "MIT notice", "MIT as is", "MIT liability"]
    assert got[99].licences == [] and got[99].sentences == []


def test_no_rows(docs_of):
    assert scan(docs_of([])).count() == 0


def test_rules_name_known_sentences():
    known = {*SENTENCES, "Copyright"}
    assert all(x in known for _, seq in RULES for x in seq)
    every = [t for texts in SENTENCES.values() for t in texts]
    assert len(every) == len(set(every))


def test_hints_miss_no_known_sentence():
    assert all(re.search(HINTS, t) for texts in SENTENCES.values() for t in texts)


def test_notices_in_any_spacing_and_of_any_length(docs_of):
    holders = ", ".join(f"Holder Number {i}" for i in range(40))
    cases = {
        "All rights\nreserved.": ["Reserved"], "All rights  reserved": ["Reserved"], "all_rights_reserved": ["Reserved"],
        f"Copyright (c) 2020 {holders}": ["Copyright"], f"Copyright (c)\n2020 {holders}": ["Copyright"],
        f"Copyright 2020 {holders}\nReleased under the MIT License": ["Copyright", "MIT name"],
        "all rooms are reserved": [],
    }
    got = {r.row.doc_id: r.sentences for r in scan(docs_of(list(enumerate(cases)))).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
