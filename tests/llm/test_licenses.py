import random

import pytest

from demandlens.llm import licenses

PROSE = ["the", "river", "of", "and", "stone", "under", "work", "public", "general", "rights", "version", "walks", "in", "house"]


@pytest.fixture(scope="module")
def found(docs_of):
    rnd = random.Random(3)
    plain = [" ".join(rnd.choice(PROSE) for _ in range(rnd.randrange(5, 40))) + "." for _ in range(120)]
    rows = [(k, "\n".join(plain[k % 120:k % 120 + 3])) for k in range(120)]
    planted = {
        200: ("mit", "text before\nReleased under the MIT License.\ntext behind"),
        201: ("apache", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"),
        202: ("gpl", f"{plain[1]} \n This work is licensed under the GNU General Public License, version 3. "),
        203: ("cc,proprietary", "Licensed under CC BY-NC 4.0.\nAll rights reserved."),
        204: ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met:"),
        205: ("", None), 206: ("", ""), 207: ("", " \n\n "), 208: ("", "He lost his driving license and had to take the test again"),
    }
    rows += [(k, t) for k, (_, t) in planted.items()] + [(200, planted[200][1]), (None, "Released under the MIT License.")]
    return rows, planted, licenses.report(docs_of(rows)).collect()


def test_families(found):
    rows, planted, got = found
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {k: by[k].families for k in planted} == {k: f for k, (f, _) in planted.items()}
    assert all(by[k].n_licensed == 0 for k in range(120))
    assert by[203].n_licensed == 2 and by[200].n_licensed == 1 and by[200].n_paragraphs == 3 and by[205].n_paragraphs == 0
    assert all((r.top_family is None) == (r.n_licensed == 0) for r in got)
    assert by[None].families == "mit"


def test_pairs_of_templates_equal_the_columns(llm):
    from pyspark.sql import functions as F
    for texts in licenses.TEMPLATES.values():
        df = llm.createDataFrame([(t,) for t in texts], "text string").select("text", licenses.pairs(licenses.tokens(F.col("text"))).alias("p"))
        for r in df.collect():
            assert [x.strip() for x in r.p] == licenses._pairs_of(r.text)


def test_empty_table(docs_of):
    assert licenses.report(docs_of([])).collect() == []
