import math
import pickle
import random
import re
from collections import Counter

from inkwell.llm import decontaminate
from inkwell.llm.decontaminate import ENTRY_WORDS, build_index, contaminated, terms_of


def prose(rng, n):
    words = ["the", "of", "and", "to"] * 5 + [f"word{i}" for i in range(400)]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def bm25(items):
    """(entries as (item, {word: weight}), weights divided by the entry's sum) in plain Python."""
    cut = [(k, w[a : a + ENTRY_WORDS]) for k, text in items for w in [re.findall(r"\w+", text.lower())] for a in range(0, len(w), ENTRY_WORDS)]
    df = Counter(w for _, e in cut for w in set(e))
    mean, out = sum(len(e) for _, e in cut) / len(cut), []
    for k, e in cut:
        w = {t: math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(e) / mean)) for t, n in Counter(e).items()}
        out.append((k, {t: x / sum(w.values()) for t, x in w.items()}))
    return out


def test_search_finds_all_that_brute_force_scores(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice((5, 12, 40, 150)))) for i in range(60)]
    texts = [prose(rng, rng.randrange(0, 400)) for _ in range(40)] + [prose(rng, 90) + " " + items[i][1] + " " + prose(rng, 30) for i in range(0, 60, 3)]
    want = {}
    for k, text in enumerate(texts):
        w = re.findall(r"\w+", text.lower())
        for a in range(0, max(1, len(w) - ENTRY_WORDS), ENTRY_WORDS):
            have = set(w[a : a + 2 * ENTRY_WORDS])
            for item, weights in bm25(items):
                score = sum(x for t, x in weights.items() if t in have)
                if score >= 0.5:
                    want[k, item] = max(want.get((k, item), 0), score)
    assert len(want) >= 20
    words, at = terms_of(texts)
    for shard_entries in (20_000, 9):
        monkeypatch.setattr(decontaminate, "SHARD_ENTRIES", shard_entries)
        built = build_index(spark.createDataFrame(items, "item long, text string"), 5).collect()
        assert (len(built) > 1) == (shard_entries == 9)
        got = {}
        for r in built:
            index = pickle.loads(r["index"])
            got |= {(t, int(index.items[k])): s for t, k, s in index.search(words, at, 0.5)}
        assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)


def test_scores_do_not_depend_on_shards_or_waves(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, 30) + f". b{i} c{i % 3}.") for i in range(30)] + [(99, prose(rng, 400))]
    docs = spark.createDataFrame([(i, f"x y z {items[i % 31][1]} tail") for i in range(62)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(tuple(r) for r in contaminated(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(decontaminate, "SHARD_ENTRIES", 7)
    assert rows() == whole and {(r[0], r[1]) for r in whole} == {(i, items[i % 31][0]) for i in range(62)}
    monkeypatch.setattr(decontaminate, "WAVE_BYTES", 1)
    assert rows() == whole


def test_question_and_answer_are_both_needed(spark):
    rng = random.Random(9)
    question, answer = prose(rng, 30).replace(".", "") + ".", "The answer is forty two apples."
    docs = spark.createDataFrame([(1, f"a b {question} {answer} c"), (2, f"a b {question} c d"), (3, f"{answer} x"), (None, f"{question} {answer}"), (4, f"{question} {answer}"), (4, "other"), (None, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, f"{question} {answer}"), (7, f"{question} {answer}"), (8, None)], "item_id long, text string")
    assert Counter((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()) == {(1, 7): 2, (None, 7): 2, (4, 7): 2}


def test_contaminated_documents(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, 40) + ". Answer " + prose(rng, 12) + ".") for i in range(50)] + [(90, None), (91, ""), (92, "...")]
    rows, want = [], set()
    for i in range(300):
        text = prose(rng, rng.randrange(1, 600))
        if i % 4 == 0:
            k = rng.randrange(50)
            text = " ".join((text, items[k][1].upper() if i % 8 else re.sub(r"\s+", "\n", items[k][1]), prose(rng, 50)))
            want.add((i, k))
        rows.append((i, text))
    near = items[3][1].split()
    near[20] = "changed"
    rows += [(900, " ".join(near)), (901, None), (902, ""), (903, " ".join(items[5][1].split()[:20]))]
    want.add((900, 3))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, bm25 int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []
