import re
from collections import Counter

import pytest
from odd import ROWS, check_shapes, documents, sentence

from pricetrail.llm import rules
from pricetrail.llm.common import table

LOOP = " ".join(["one two three four five six seven eight nine"] * 7)
TEXTS = [
    *ROWS, (20, LOOP), (21, LOOP + " " + sentence(5, 40)), (22, "x " * 40), (23, "A B# C* " * 30),
    (24, "same line\n" * 9 + sentence(6, 50)), (25, sentence(7, 7)), (26, sentence(8, 8)),
    (27, "\n".join([sentence(9, 25)] * 2) + "\nend"), (28, "ÄÖÜ É " * 30), (29, "a b " * 30),
]


def measured(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_capitals": sum(c.isupper() for c in text),
    }


def expected(key, text):
    m = measured(text)
    fails = [
        m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"],
        10 * m["n_symbols"] > m["n_words"], 2 * m["n_dup_lines"] > m["n_lines"],
        m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 15 * m["n_words"],
        2 * m["n_capitals"] > m["word_chars"],
    ]
    bits = sum(1 << k for k, failed in enumerate(fails) if failed)
    row = m | {"doc_id": key, "failures": bits, "base_failed": any(fails[:2]), "kept": bits == 0}
    return tuple(row[k] for k in sorted(row))


def test_ledger(spark):
    got = check_shapes(documents(spark, TEXTS), rules.quality)
    assert got == sorted((expected(*r) for r in TEXTS), key=repr)


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = rules.quality(docs)
    columns = sorted(got.columns)
    want = sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == want


def test_no_python(spark):
    plan = rules.quality(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("policy", rules.POLICIES, ids=lambda p: p.version)
def test_policies_and_ablation(spark, policy):
    entries = rules.ledger(rules.measure(documents(spark, TEXTS)))
    rows = rules.apply_policies(entries).collect()
    assert all(r[f"kept_{policy.version}"] == (r.failures & policy.mask == 0) for r in rows)
    got = {r.rule: (r.failed, r.only) for r in rules.ablation(entries, policy).collect()}
    for name in policy.rules:
        bit = 1 << rules.BIT[name]
        assert got[name] == (
            sum(r.failures & bit != 0 for r in rows),
            sum(r.failures & policy.mask == bit for r in rows),
        )
