import random

import brute
import pytest

from demandlens.llm import pii

TEXTS = [
    "", None, "mail me@x.org, or a@b.com_x@y.zz now", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3", "4736962573099581 and 4736-9625 7309 9581",
    "12 34 56 78 90 12 34 56 78 90 12", "0" * 19 + " " + "0" * 20, "+1 (974) 555-3436 +12 +49(0)30-1234567890123", "é@b.com日a@日.com a@b..c a@b.c.",
    "5 4736962573099581 5", "card4736962573099581card", "x" * 3000 + "@", "1" * 4000, "+" * 50 + "123456789", "1.1.1.1\n2.2.2.2\t3.3.3.300",
    "😀 a@b.co 😀 10.0.0.1", "- 4-7-3-6-9-6-2-5-7-3-0-9-9-5-8-1 -", "%a@b.c+d@e.f", "1-2" * 30,
]


def _random():
    rnd = random.Random(8)
    for _ in range(200):
        yield "".join(rnd.choice(["1", "2", "47", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "é", "\n", "0", "9"]) for _ in range(rnd.randrange(5, 70)))


def test_base_spans_equal_brute_force(docs_of):
    rows = list(enumerate([*TEXTS, *_random()]))
    got = {r.doc_id: tuple(r)[1:6] for r in pii.report(docs_of(rows)).collect()}
    assert got == {k: brute.pii(t) for k, t in rows}


@pytest.mark.parametrize("text,kind", [
    ("IBAN DE89 3704 0044 0532 0130 00.", "iban"), ("account GB82WEST12345698765432!", "iban"), ("my SSN is 123-45-6789", "ssn"),
    ("phone: (555) 123-4567", "local_phone"),
])
def test_added_kinds(docs_of, text, kind):
    row = pii.report(docs_of([(1, text)])).first()
    assert any(s.startswith(kind + ":") for s in row.spans.split(",")), row.spans


@pytest.mark.parametrize("text", ["DE89 3704 0044 0532 0130 01", "code 123-45-6789", "000-12-3456 ssn", "order 555-123-4567", "GB82WEST1234569876543"])
def test_checks_and_context_hold_back(docs_of, text):
    assert pii.report(docs_of([(1, text)])).first().spans == ""


def test_spans_of_base_stay_and_positions_are_code_points(docs_of):
    row = pii.report(docs_of([(1, "😀é a@b.co, IBAN DE89370400440532013000")])).first()
    assert row.spans.split(",")[0] == "email:3:9" and "iban:16:38" in row.spans


def test_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "a@b.co")]
    got = pii.report(docs_of(rows)).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 3
    assert pii.report(docs_of([])).collect() == []
