import math
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tokenloom.llm.spans import texts_of
from tokenloom.llm import leakage, naturalness, queries, repetition
from tokenloom.session import stage_table

LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall("[a-z0-9]+", t.translate(LOW))


# ---------------------------------------------------------------- leakage
RECORDS = "rec_id long, text string, ids array<int>, split string, item_id int"
ITEMS = "item_id long, suite string, text string, rec_id int"


def leak_data():
    rnd = random.Random(5)
    item = [" ".join(f"q{rnd.randrange(500)}" for _ in range(n)) for n in (40, 13, 12, 60)]
    w = item[0].split()
    records = [
        (1, "before " + ", ".join(w[5:18]).upper() + " after", None),  # just 13 words, otherwise written
        (2, " ".join(w[5:17]), None),  # 12
        (3, " ".join(w[0:13]) + " x " + " ".join(w[20:33]), None),
        (4, item[1] + ". " + item[2], None),  # all of a 13 word item; a 12 word item never counts
        (5, None, [0, 1, 2]),  # only in ids
        (6, None, None),
        (7, "", None),
        (8, "é🙂 " + item[3] + " 木", None),
        (None, item[0], None),
    ]
    pieces = [(0, item[1][:20]), (1, item[1][20:]), (2, " end"), (50256, "<end>")]
    items = [(i, "s", t) for i, t in enumerate(item)] + [(10, None, item[0]), (11, "s", None), (12, "s", ""), (None, "s", item[0])]
    return records, items, pieces


def brute_leaks(records, items, pieces):
    p = dict(pieces)
    out = set()
    for r, t, ids in records:
        if r is None or t is None and ids is None:
            continue
        w = words(t if t is not None else "".join(p[i] for i in ids))
        have = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for i, _, it in items:
            v = words(it or "")
            if i is not None and any(tuple(v[k : k + 13]) in have for k in range(len(v) - 12)):
                out.add((r, i))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_leaks_match_brute_force(spark, block):
    records, items, pieces = leak_data()
    rows = spark.createDataFrame([(*r, "train", 1) for r in records + records[:4]], RECORDS)
    its = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    voc = spark.createDataFrame(pieces, "token_id int, piece string")
    got = leakage.leaked_passages(rows, its, voc, block_bytes=block).collect()
    assert sorted((r.rec_id, r.item_id) for r in got) == sorted(brute_leaks(records, items, pieces))
    assert {r.item_id: r.spans for r in got if r.rec_id == 8}[3] == [(3, 3 + len(items[3][2]))]
    assert leakage.leaked_passages(rows.limit(0), its, voc).count() == 0
    assert leakage.leaked_passages(rows, its.limit(0), voc).count() == 0


def test_passages_are_cut_out(spark):
    records, items, _ = leak_data()
    rows = spark.createDataFrame([(*r, "train", 1) for r in records], RECORDS)
    found = leakage.leaked_passages(rows, spark.createDataFrame([(*i, 1) for i in items], ITEMS))
    left = {r.rec_id: (r.text, r.removed_share) for r in leakage.without_passages(rows, found, max_share=0.9).collect()}
    assert left[1][0] == "before  after" and left[2] == (records[1][1], 0.0)
    assert left[6] == (None, 0.0) and left[7] == ("", 0.0) and 4 in left
    assert 3 not in left  # nearly all of it leaked


def test_passages_in_ids_are_cut_out_too(spark):
    records, items, pieces = leak_data()
    pieces = pieces[:2] + [(2, " end é🙂 of it all, and then some more words that nobody asked for, one by one, to the very end of this long text"), pieces[3]]
    rows = spark.createDataFrame([(*r, "train", 1) for r in records + records[4:6]], RECORDS)
    its, voc = spark.createDataFrame([(*i, 1) for i in items], ITEMS), spark.createDataFrame(pieces, "token_id int, piece string")
    found = leakage.leaked_passages(rows, its, voc)
    left = {r.rec_id: (r.text, r.removed_share) for r in leakage.without_passages(rows, found, voc).collect()}
    assert left[5][0] == pieces[2][1] and left[5][1] > 0.2 and left[6] == (None, 0.0) and left[7] == ("", 0.0)
    assert 3 not in left and left[2] == (records[1][1], 0.0)
    again = spark.createDataFrame([(k, t) for k, (t, _) in left.items()], "rec_id long, text string")
    assert leakage.leaked_passages(again, its).count() == 0
    assert leakage.without_passages(rows.limit(0), found, voc).count() == 0
    assert leakage.without_passages(rows, found.limit(0), voc).where("removed_share > 0").count() == 0


# ---------------------------------------------------------------- repetition
def plain_repetition(text):
    w = words(text)
    seen, rep = set(), [False] * len(w)
    for k in range(len(w) - 4):
        g = tuple(w[k : k + 5])
        if g in seen:
            rep[k : k + 5] = [True] * 5
        seen.add(g)
    return len(w), sum(rep)


def test_repetition_matches_a_plain_scan(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["x " * 100_000, "", None, "One. One. Two.\nTwo.\nTwo."]
    rows = [(i, t, None if i % 3 else "s", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:9] + [(None, "a b", "s", 1)], "rec_id long, text string, source string, n_words int")
    got = {r.rec_id: r for r in repetition.repetition_stats(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].n_words is None and got[i].rep_share is None
        else:
            assert (got[i].n_words, got[i].n_repeated) == plain_repetition(t)
    assert got[63].dup_sentence_share == pytest.approx(9 / 15) and got[63].dup_line_share == pytest.approx(4 / 22)
    assert repetition.repetition_stats(df.limit(0)).count() == 0


def test_exact_bounds():
    assert repetition.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert repetition.upper_bound(3, 50, 0.05) == pytest.approx(0.14783, abs=1e-4)
    assert repetition.upper_bound(5, 5, 0.1) == 1.0 and repetition.upper_bound(0, 0, 0.1) == 1.0
    assert repetition.binomial_tail(4, 4, 0.3) == pytest.approx(1)


def test_cutoffs_bound_false_rejections():
    rng = np.random.default_rng(1)
    broken = 0
    for _ in range(40):
        n = 4000
        frame = pd.DataFrame({"stratum": rng.choice(["a", "b", None, "tiny"], n, p=[0.5, 0.3, 0.19, 0.01]), "good": rng.random(n) < 0.95})
        for m in repetition.MEASURES:
            frame[m] = np.where(frame["good"], rng.beta(1, 4, n), 1.0)
        for c in repetition.risk_controlled_cutoffs(frame):
            assert c.cutoff in repetition.GRID
            if c.certified:
                assert c.upper <= 0.10 + 1e-9
                broken += (1 - c.cutoff) ** 4 > 0.10  # the true rate of this distribution
    assert broken <= 2
    strata = {c.stratum for c in repetition.risk_controlled_cutoffs(frame)}
    assert strata == {"a", "b", "(none)", repetition.POOLED}
    for few in (frame.head(0), frame.head(100)):  # says nothing: the definition's cutoff, not certified
        assert {(c.stratum, c.cutoff, c.certified) for c in repetition.risk_controlled_cutoffs(few)} == {(repetition.POOLED, repetition.CASE_SHARE, False)}


def repeated_rows(n, good):
    """Every tenth record says its words twice over."""
    text = lambda i: " ".join(f"a{i}w{k}" for k in range(30))
    rows = [(i, (text(i) + " ") * (2 if i % 10 == 0 else 1), ("s", "t", None)[i % 3]) for i in range(n)]
    return rows, [(i, "prose" if good(i) else "junk") for i in range(n)]


def test_labels_decide_what_is_flagged(spark):
    found = {}
    for name, good in {"cases are junk": lambda i: i % 10, "cases are prose": lambda i: True, "prose in one source": lambda i: i % 10 or i % 3 == 0}.items():
        rows, labels = repeated_rows(3000, good)
        stats = stage_table(repetition.repetition_stats(spark.createDataFrame(rows, "rec_id long, text string, source string")), "stats")
        cutoffs = repetition.choose_cutoffs(stats, spark.createDataFrame(labels + [(1, None), (None, "prose")], "rec_id long, label string"), alpha=0.05)
        flagged = repetition.flag_repetition(stats, cutoffs)
        found[name] = {r.rec_id for r in flagged.where("flag_rep_share").collect()}
        assert flagged.where(repetition.is_case()).count() == 300
    # a repeated half is a share of 0.5: it is turned away unless people call such records good
    assert found["cases are junk"] == set(range(0, 3000, 10))
    assert found["cases are prose"] == set()
    assert found["prose in one source"] == {i for i in range(0, 3000, 10) if i % 3}


def test_every_label_counts(spark):
    """25,000 labelled records, of which a small source has just enough and a rarer one too few."""
    n = 25_000
    source = [f"s{i % 3}" if i % 50 else None if i % 100 else "rare" if i % 1000 else "few" for i in range(n)]
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"rec_id": range(n), "source": source, "n_words": 100} | {m: rng.beta(1, 12, n).round(3) for m in repetition.MEASURES})
    rows.loc[rows.index % 100 < 15, "rep_share"] = 0.45
    rows.loc[rows.index % 7 == 0, "dup_line_share"] = None
    label = [(i, "junk" if i % 10 == 3 else "prose") for i in range(n)] + [(5, "list"), (6, None), (n + 1, "prose"), (None, "prose")]
    stats = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "rec_id long, source string, n_words int, " + ", ".join(f"{m} double" for m in repetition.MEASURES))
    got = repetition.choose_cutoffs(stats, spark.createDataFrame(label, "rec_id long, label string"), least=225)
    good = (rows["rec_id"] % 10 != 3) & (rows["rec_id"] != 5)
    assert got == repetition.risk_controlled_cutoffs(rows.rename(columns={"source": "stratum"}).assign(good=good), least=225)
    sizes = {c.stratum: c.n_good for c in got}
    assert sum(sizes.values()) == good.sum() and sizes["rare"] == 225 and sizes["(none)"] == 250 and sizes[repetition.POOLED] == 25


def test_found_follows_the_definition_whatever_the_labels(spark, tmp_path):
    rows, labels = repeated_rows(3000, lambda i: True)
    spark.createDataFrame(rows, "rec_id long, text string, source string").write.parquet(str(tmp_path / "general_purpose_prepare.parquet"))
    spark.createDataFrame(labels, "rec_id long, label string").write.parquet(str(tmp_path / "quality_labels.parquet"))
    assert {r.rec_id for r in queries.p2_found(spark, str(tmp_path)).collect()} == set(range(0, 3000, 10))
    assert queries.p2_flagged(spark, str(tmp_path)).where("flag_rep_share").count() == 0  # people call them prose


def test_tail_of_many_trials():
    for k, n, p in ((0, 30, 0.2), (29, 30, 0.2), (700, 6000, 0.1), (5990, 6000, 0.9), (350, 2000, 0.9)):
        whole = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert repetition.binomial_tail(k, n, p) == pytest.approx(whole, rel=1e-6, abs=1e-300)
    began = time.perf_counter()
    assert repetition.binomial_tail(9_000_000, 10**7, 0.1) == pytest.approx(1, abs=1e-6) and repetition.binomial_tail(10**6, 10**7, 0.1) == pytest.approx(0.5, abs=1e-3)
    assert time.perf_counter() - began < 2


def test_short_and_null_texts_are_not_flagged(spark):
    rows = [(1, "a b c d e " * 3, "s"), (2, None, "s"), (3, "", None), (4, "a b c d e " * 4, None)]
    stats = repetition.repetition_stats(spark.createDataFrame(rows, "rec_id long, text string, source string"))
    none = spark.createDataFrame([], "rec_id long, label string")
    got = {r.rec_id: (r.flag_rep_share, r.flagged) for r in repetition.flag_repetition(stats, repetition.choose_cutoffs(stats, none)).collect()}
    assert got == {1: (False, False), 2: (None, None), 3: (False, False), 4: (True, True)}


# ---------------------------------------------------------------- naturalness
PROSE = "The {} was in the {} when it had been moved by a {} that no one knew, and so they left. "


def make(kind, rnd):
    w = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))
    if kind == "prose":
        return "".join(PROSE.format(w(), w(), w()) for _ in range(rnd.randint(2, 9)))
    if kind == "list":
        return "\n".join(f"- {w()} {w()}" for _ in range(rnd.randint(8, 40)))
    if kind == "table":
        return "\n".join(f"{w()} | {rnd.random():.3f} | {rnd.randrange(999)}" for _ in range(rnd.randint(8, 40)))
    return "".join(rnd.choice("#$%&*@!<>{}[]~^ab01") for _ in range(rnd.randint(80, 900)))


def test_kinds_on_held_out_texts(spark):
    rnd = random.Random(4)
    kinds = ["prose"] * 7 + ["list", "table", "junk"]
    truth = [rnd.choice(kinds) for _ in range(600)]
    rows = [(i, make(k, rnd), "x") for i, k in enumerate(truth)] + [(1000, None, "x"), (1001, "", "x"), (1002, "   \n ", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows + rows[:5], "rec_id long, text string, kind string")
    labels = spark.createDataFrame([(i, truth[i] if i % 20 else "junk") for i in range(200)] + [(5, None), (6, "other"), (None, "prose")], "rec_id long, label string")
    got = {r.rec_id: r for r in naturalness.classify(df, labels).collect()}
    assert len(got) == 603
    held = range(200, 600)
    assert np.mean([(got[i].nonprose_share > 0.5) == (truth[i] != "prose") for i in held]) == 1
    assert np.mean([(got[i].kind == "prose") == (truth[i] == "prose") for i in held]) > 0.97
    assert got[1000].kind is None and got[1000].n_words is None
    assert got[1001].n_chars == 0 and got[1001].nonprose_share == 0.0
    again = {r.rec_id: r for r in naturalness.classify(df.repartition(3), labels).collect()}
    assert [again[i].kind for i in held] == [got[i].kind for i in held]


def test_labels_name_the_components(spark):
    rnd = random.Random(8)
    truth = [("prose", "list", "table")[i % 3] for i in range(300)]
    df = spark.createDataFrame([(i, make(k, rnd)) for i, k in enumerate(truth)], "rec_id long, text string")
    called = lambda f: {r.rec_id: r.kind for r in naturalness.classify(df, spark.createDataFrame([(i, f(truth[i])) for i in range(60)], "rec_id long, label string")).collect()}
    right = called(lambda k: k)
    assert np.mean([right[i] == truth[i] for i in range(60, 300)]) > 0.97
    assert set(called(lambda k: "prose").values()) == {"prose"}  # without examples of anything else nothing else is found
    other = called(lambda k: {"list": "junk"}.get(k, k))
    assert np.mean([other[i] == "junk" for i in range(60, 300) if truth[i] == "list"]) > 0.97


def test_numbered_items_are_no_prose():
    texts = ["\n".join(f"No. {i}: {a} {b}" for i, (a, b) in enumerate([("jolly", "reef"), ("urgent", "loaf"), ("simple", "trail")] * 5)), "There is no. It was said, and no one knew of it. " * 4]
    share = naturalness.text_statistics(texts_of(pa.array(texts)), naturalness._common_hashes())["nonprose_share"]
    assert share[0] > 0.5 and share[1] < 0.2


def test_no_labels_and_no_records(spark):
    df = spark.createDataFrame([(1, "some text")], "rec_id long, text string")
    none = spark.createDataFrame([], "rec_id long, label string")
    assert naturalness.classify(df, none).first().kind is None
    assert naturalness.classify(df.limit(0), none).count() == 0


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1, "The cat, the dog.\nÉh 12"), (2, "gladly gladly gladly gladly gladly gladly")], "rec_id long, text string")
    got = {r.rec_id: r for r in naturalness.quality_stats(df).collect()}
    s = got[1]
    assert (s.n_chars, s.n_words) == (23, 6)
    assert s.mean_word_len == pytest.approx((3 * 4 + 1 + 2) / 6)
    assert s.symbol_share == pytest.approx(3 / 23) and s.digit_share == pytest.approx(2 / 23)
    assert s.punct_line_share == 0.5 and s.common_share == pytest.approx(2 / 6)
    assert got[2].nonprose_share == 0.0  # prose that stammers is prose


def test_tables_that_repeat_beside_prose_are_not_prose():
    prose = "We went over to the market in the morning, and it was so full of people that we could not get to any of the stalls."
    rows = ["4411;north;7.25;ok\n", "8120;south;1.75;late\n", "3377;west;0.5;void\n"]
    data = [
        "\nid,4411,2024-05-06,17.25,ok" * 40,
        "\nx1,22,ok" * 80,
        "\n2024-05-06 12:44:01 WARN worker-7 disk sda1 retry queue=12 status=503 latency=88ms" * 40,
        "\n" + "".join(random.Random(1).choice(rows) for _ in range(60)),
        "\n" + "click banner win prize code zz9 " * 50,
        "\n- blue paint\n- steel nails\n- oak board" * 20,
    ]
    again = [" " + prose] * 20, [" The shiny red garden chair arrived late on Monday."] * 30
    texts = [prose + d for d in data] + [prose + "".join(a) for a in again]
    share = naturalness.text_statistics(texts_of(pa.array(texts)), naturalness._common_hashes())["nonprose_share"]
    assert (share[: len(data)] > 0.5).all() and (share[len(data) :] < 0.2).all()
