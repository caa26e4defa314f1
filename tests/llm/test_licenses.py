"""License notices in their usual layout, and several notices in one paragraph."""

import pytest

from evidex.llm import licenses

LONG = [(n, t) for n, t in licenses.TEMPLATES if len(licenses.words(t)) > 30]
MIT = licenses.TEMPLATES[1][1]
#: Where the usual layout of a template begins a paragraph.
BREAKS = ("The above copyright notice", "Unless required", "Redistributions of", "If a copy", "you may not", "You may obtain")


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def layout(text):
    for part in BREAKS:
        text = text.replace(f" {part}", f"\n\n{part}")
    return text


@pytest.mark.parametrize(("name", "text"), LONG, ids=[n for n, _ in LONG])
def test_paragraphs_of_a_notice_are_one_notice(scanner, name, text):
    own = layout(text)
    half = len(text.split()) // 2
    for shown in (own, " ".join(text.split()[:half]) + "\n \n\n" + " ".join(text.split()[half:])):
        whole = f"Some words before.\n\n{shown}\n\nSome words after."
        found = [f for f in scanner.scan(whole) if f["license"] == name and f["n_different"] == 0]
        assert shown.rstrip("./") in [whole[f["begin"] : f["stop"]] for f in found]


@pytest.mark.parametrize("gap", [" ", "\n", "\n\n", " and then some other words here "])
@pytest.mark.parametrize("text", [MIT, "Released under the MIT License.", LONG[0][1]])
def test_every_notice_is_reported(scanner, text, gap):
    whole = gap.join([text] * 5)
    names = {n for n, t in licenses.TEMPLATES if t == text}
    found = [f for f in scanner.scan(whole) if f["license"] in names and f["n_different"] == 0]
    want = [i * len(text + gap) for i in range(5)]
    assert [f["begin"] for f in found if f["stop"] - f["begin"] >= len(text) - 1] == want


def test_cut_and_changed_notices_count_once(scanner):
    changed = MIT.replace("free of charge", "free of cost")
    far = " ".join(f"word{i}" for i in range(400))
    found = [f for f in scanner.scan(f"{far} {MIT} {changed} {far} {MIT}") if f["license"] == "MIT"]
    assert [(f["n_different"], f["missing"]) for f in found] == [(0, []), (1, ["charge"]), (0, [])]
