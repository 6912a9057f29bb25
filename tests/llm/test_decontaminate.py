import random

import brute
import pytest

from demandlens.llm import decontaminate


def _case(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    bench = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 40])))) for k in range(30)]
    bench += [(30, None), (31, "!!! --"), (32, bench[5][1])]
    docs = []
    for k in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            item = (rnd.choice(bench)[1] or "").split()
            cut = rnd.randrange(0, 5)
            text[rnd.randrange(0, len(text) + 1):0] = [x.upper() for x in item[cut:]]
        docs.append((k, rnd.choice([" ", "-", "\n", " , "]).join(text)))
    return docs + [(100, None), (101, ""), (102, "WÖRD wörd")], bench


def _bench(llm, rows):
    return llm.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, n_words string")


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(llm, docs_of, seed):
    docs, bench = _case(seed)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs_of(docs), _bench(llm, bench)).collect()}
    assert got == brute.decontaminate(docs, bench)


def test_benchmark_beyond_the_bound_is_sliced(llm, docs_of):
    docs, bench = _case(9)
    docs = [*docs, docs[3], docs[3]]  # rows that repeat
    whole = decontaminate.decontaminate(docs_of(docs), _bench(llm, bench))
    sliced = decontaminate.decontaminate(docs_of(docs), _bench(llm, bench), words=40)
    assert sorted(map(str, sliced.collect())) == sorted(map(str, whole.collect()))


def test_empty_tables(llm, docs_of):
    none = _bench(llm, [])
    got = decontaminate.report(docs_of([(1, "a b c")]), none).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got] == [(3, 0, 0, False)]
    assert decontaminate.report(docs_of([]), none).collect() == []
