"""Operators of the subpackage llm against brute force and on odd inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaza.llm import abuse, residue
from plaza.llm.conversations import arrivals, conversations, event_time, judge
from plaza.llm.mixing import Mixture, decide, fly
from plaza.llm.neardup import BAND_ROWS, BANDS, NearDuplicates, SuperMinHash, pack as pack_keys, shared_keys, unpack
from plaza.llm.packing import pack, plan
from plaza.llm.raking import Sample, Target, rake, repair
from plaza.llm.spelling import Speller, disguised
from plaza.llm.tokenizer import token_lengths
from plaza.llm.tokens import slices, word_hash, words

# --- words ---------------------------------------------------------------


def test_words_equal_a_plain_tokenizer():
    texts = ["Hello, World! it's", "", "été déjà 12", "a.b\nc", "x" * 5000 + " y"]
    w = words([t.encode() for t in texts])
    want = [(i, m.lower()) for i, t in enumerate(texts) for m in re.findall(r"[A-Za-z0-9'\u0080-￿]+", t)]
    assert w.doc.tolist() == [i for i, _ in want]
    assert w.hash.tolist() == [word_hash(m) for _, m in want]
    assert len(words([]).hash) == 0


def test_words_in_large_batches_hash_alike():
    text = ("alpha beta " * 200_000).encode()
    w = words([text])
    assert set(w.hash.tolist()) == {word_hash("alpha"), word_hash("beta")}


def test_slices_cover_every_row_once():
    texts = ["ab", None, "c" * 50, "", "d" * 9, "e"]
    got = list(slices(pa.array(texts), 10))
    assert [t for _, part in got for t in part] == texts
    assert [i for i, _ in got] == [0, 2, 3]
    assert list(slices(pa.array([], pa.string()))) == []


# --- spelling ------------------------------------------------------------

LEXICON = {"idiot", "vermin", "trash", "brainless", "fuck", "rats", "sex", "maggot"}


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("idi​ot", "idiot"), ("v e r m i n and", "vermin and"), ("i-d-i-o-t", "idiot"), ("7r4$h", "trash"), ("br41nl3$$", "brainless"), ("f**k", "fuck"), ("ra*s", "rats"),
        ("s.e.x tape", "sex tape"), ("magggggot", "maggot"), ("idiоt", "idiot"), ("from $5 to $836", "from $5 to $836"), ("@user404 hi", "@user404 hi"), ("plain text", "plain text"), ("", ""),
    ],
)
def test_speller(given, want):
    assert Speller(LEXICON)(given) == want
    if given != want:
        assert disguised([given.encode()]).tolist() == [0]


# --- abuse ---------------------------------------------------------------

BAD = ["you are a stupid {0}, shut your filthy mouth", "all {0} people should be wiped out, they are vermin", "kys you worthless {0}", "I will find you and break your jaw {0}"]
FINE = ["the {0} market was lovely today", "who else thinks the {0} needs a new lamp", "ugh I'm such an idiot, left my {0} outside", "calling neighbours vermin is plain wrong, {0}"]


def abuse_tables(spark, n=120):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = rng.choice(BAD if bad else FINE).format(rng.choice(["kettle", "wagon", "tram", "lamp"]))
        text = f"{rng.choice(FINE).format('zine')}. {body}." if i % 3 else body
        rows.append(("t", str(i), text))
        if i < n // 2:
            labels += [("t", str(i), 1, int(bad)), ("t", str(i), 2, int(bad) if i % 9 else None)]
    rows += [("t", "null", None), ("t", "blank", "  "), ("t", "0", rows[0][2]), ("t", "long", "lovely kettle market. " * 3000 + BAD[0].format("lamp"))]
    return spark.createDataFrame(rows, "record_table string, record_id string, text string"), spark.createDataFrame(labels, "record_table string, record_id string, annotator int, abusive int")


def test_abuse_finds_held_out_records(spark):
    records, labels = abuse_tables(spark)
    linear, lex, model, (patterns, counts) = abuse.fit(records, labels, ["idiot", "worthless"])
    got = {r.record_id: r.score for r in abuse.score(records, linear, lex).collect()}
    held = [i for i in range(60, 120)]
    right = sum((got[str(i)] >= abuse.THRESHOLD) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert got["null"] == got["blank"] == 0.0
    assert got["long"] >= abuse.THRESHOLD
    assert {a for a, _, _ in model.accuracy(patterns, counts)} == set(abuse.VOTERS)


def test_abuse_without_judgements_or_rows(spark):
    records, labels = abuse_tables(spark)
    linear, lex, _, _ = abuse.fit(records, labels.limit(0), [])
    got = {r.record_id: r.score for r in abuse.score(records, linear, lex).collect()}
    assert got["0"] > abuse.THRESHOLD > got["1"]
    linear, lex, _, _ = abuse.fit(records.limit(0), labels, [])
    assert abuse.score(records.limit(0), linear, lex).count() == 0


def test_label_model_learns_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    a = np.where(y, rng.random(len(y)) < 0.7, rng.random(len(y)) < 0.001)
    b = np.where(rng.random(len(y)) < 0.9, a, np.where(y, rng.random(len(y)) < 0.5, rng.random(len(y)) < 0.001))
    c = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.002)
    bits = a * 1 + b * 2 + c * 16
    patterns, counts = np.unique(bits, return_counts=True)
    m = abuse.LabelModel.fit(patterns, counts.astype(float))
    q = dict(zip(patterns.tolist(), m.posterior(patterns), strict=True))
    assert q[0] < 0.2
    assert q[1 + 2 + 16] >= 0.8 > 0.2 > q[0]
    assert 0 in (m.parent[0][1], m.parent[1][1])  # the copy hangs on the voter it copies


# --- residue -------------------------------------------------------------

RESIDUES = [
    "hi, I'm {{ name }} and I post", "Dear <insert city here>", "Please enable JavaScript to view the lamp board of Town.", "404 Not Found.", "Lorem ipsum dolor sit amet consectetur",
    "blah blah blah", "<html><body><h1>Access denied.</h1></body></html>", "some talk. Error 502: Bad gateway. Please try again in 20 seconds", "my <LBL:BENIGN> day", "%(tone)s here", "undefined undefined undefined",
]
CLEAN = [
    "in the templating lesson Kim showed that {{ title }} prints the title, calm trick", "typesetters still joke about lorem ipsum on every poster", "got a 404 on the tracker again, anyone else? the page was fine",
    "I turned JavaScript off to read in peace and half of town broke somehow", "the sign said access denied so we had lunch in town instead", "prices went from $5 to $836", "[laughs] really [citation needed]", "", "   ", None,
    "a " * 20000,
]


def test_residue(spark):
    filler = [f"the {a} market sells lamps in {b}" for a in ("blue", "red", "old") for b in ("spring", "autumn")] * 10
    texts = [*RESIDUES, *CLEAN, *filler]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, is_residue string")
    got = {r.doc_id: r.is_residue for r in residue.residue(df.select("doc_id", "text"), "doc_id", "text").collect()}
    assert [i for i, hit in sorted(got.items()) if hit] == list(range(len(RESIDUES)))
    assert residue.residue(df.limit(0), "doc_id", "text").count() == 0


def test_residue_in_a_very_long_text():
    j = residue.Judge(residue.default_index(), np.full(len(residue.default_index().terms), 5.0))
    long = "the market is lovely today. " * 5000
    assert j([long + "Please enable JavaScript to view the board of Town.", long]).tolist() == [True, False]


# --- conversations -------------------------------------------------------

SCHEMA = "post_id string, thread_id string, parent_id string, user_id string, timestamp string, text string, verdict string"


def messages():
    rows = [
        ("a", "t1", None, "1", "2025-01-01 10:00:00", "hi"), ("b", "t1", "a", "2", "2025-01-01T09:00:00Z", "yo"), ("c", None, "b", "1", "1735729200", "ok"), ("d", None, "c", None, None, "late"),
        ("e", "t2", None, "1", "x", "hi"), ("f", "t2", "zz", "2", None, "yo"),
        ("g", "t3", None, "1", None, "hi"), ("h", "t3", "i", "2", None, "yo"), ("i", "t3", "h", "2", None, "yo"),
        ("j", "t4", None, "1", None, " "), ("k", "t4", "j", "2", None, "[removed]"),
        ("l", "t5", None, "1", None, "hi"), ("m", "t5", "l", None, None, "yo"), ("n", "t5", "l", "1", None, "me"),
        ("o", "t6", None, "1", None, "hi"), ("p", "t6", None, "2", None, "hi"),
        ("q", None, "r", "2", None, "x"), ("r", None, "q", "2", None, "x"), ("s", None, None, "2", None, "x"),
        ("t", "t7", "u", "1", None, "x"), ("u", "t7", "t", "2", None, "x"),
        ("b", "t1", "a", "2", "2025-01-01T09:00:00Z", "yo"),
    ]
    return [(*r, "clash") for r in rows]


WANT = {"t1": None, "t2": "orphan", "t3": "cycle", "t4": "empty", "t5": "unanswered", "t6": "roots", "t7": "roots"}


@pytest.mark.parametrize("limit", [100, 2])
def test_conversations_by_stream_and_by_joins(spark, limit):
    made = conversations(spark.createDataFrame(messages(), SCHEMA), limit)
    assert {r.thread: r.verdict for r in made.verdicts.collect()} == WANT
    got = [(r.post_id, r.role, r.position) for r in made.messages.orderBy("position").collect()]
    assert got == [("a", "opener", 0), ("b", "responder", 1), ("c", "opener", 2), ("d", "responder", 3)]


def test_conversations_empty(spark):
    made = conversations(spark.createDataFrame([], SCHEMA))
    assert made.messages.count() == made.verdicts.count() == 0


def test_stream_emits_every_thread(spark):
    from plaza.llm.conversations import _stream

    rows = arrivals(spark.createDataFrame(messages(), SCHEMA))
    got = Counter()
    for r in _stream(rows, 20).collect():
        got[r.thread] += r.n_rows
    # A thread may close between two batches and open again; none of its rows is lost.
    assert got == {"t1": 4, "t2": 2, "t3": 3, "t4": 2, "t5": 3, "t6": 2, "t7": 2}


def test_stream_buffers_late_rows_over_several_batches(spark):
    day = lambda n: f"2025-01-{n:02d} 12:00:00"
    rows = []
    for k in range(1, 28, 3):  # a thread a batch or so, whose answer comes before its question
        rows += [(f"r{k}", f"t{k}", f"o{k}", "2", day(k), "yes", ""), (f"o{k}", f"t{k}", None, "1", day(k), "who", "")]
    rows[10:10] = [("open", "slow", None, "1", day(10), "who", "")]  # its answer comes batches later, but within the lateness
    rows.insert(13, ("answer", "slow", "open", "2", day(13), "me", ""))
    rows.append(("r1b", "t1", "o1", "3", day(1), "too late for the state", ""))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", seq int")
    made = conversations(df, batches=6, order="seq")
    by = {r.thread: (r.n_rows, r.verdict, r.by_stream) for r in made.verdicts.collect()}
    assert by == {f"t{k}": (3 if k == 1 else 2, None, k != 1) for k in range(1, 28, 3)} | {"slow": (2, None, True)}
    told = {(r.thread, r.position): (r.post_id, r.role) for r in made.messages.collect()}
    assert len(told) == len(rows) and told["t1", 0] == ("o1", "opener") and {told["t1", 1][0], told["t1", 2][0]} == {"r1", "r1b"}
    assert [told["slow", k] for k in (0, 1)] == [("open", "opener"), ("answer", "responder")]


def test_random_threads_agree(spark):
    rng = random.Random(7)
    data = []
    for t in range(60):
        n = rng.randrange(1, 7)
        for k in range(n):
            parent = None if k == 0 and rng.random() < 0.9 else f"{t}-{rng.randrange(n)}" if rng.random() < 0.9 else "gone"
            data.append((f"{t}-{k}", f"T{t}", parent, rng.choice(["1", "2", None]), None, rng.choice(["x", "", "[deleted]"]), ""))
    df = spark.createDataFrame(data, SCHEMA)
    by_stream = {r.thread: r.verdict for r in conversations(df).verdicts.collect()}
    by_joins = {r.thread: r.verdict for r in conversations(df, 0).verdicts.collect()}
    per = defaultdict(list)
    for p, t, up, u, _, x, _ in data:
        per[t].append([p, up, u, None, x != "x"])
    assert by_stream == by_joins == {t: judge(r) for t, r in per.items()}


def test_event_time_formats(spark):
    given = ["2025-01-26 12:13:24", "2025-01-26T12:13:24", "2025-01-26T12:13:24Z", "2025-01-26T14:13:24+02:00", "1737893604", "2025-01-26 12:13:24.5", "nonsense", "", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, c string")
    got = [r.t for r in df.select("i", F.unix_millis(event_time(F.col("c"))).alias("t")).orderBy("i").collect()]
    assert got == [1737893604000] * 5 + [1737893604500, None, None, None]


# --- near duplicates -----------------------------------------------------


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    sign = SuperMinHash(256)
    for share in (0.2, 0.5, 0.9):
        both = int(200 * share)
        e = rng.integers(0, 1 << 60, 400 - both, dtype=np.uint64)
        a, b = e[:200], np.concatenate([e[:both], e[200:]])
        s = sign(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert abs((s[0] == s[1]).mean() - both / (400 - both)) < 0.1


def test_superminhash_does_not_depend_on_batches():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    one = SuperMinHash(BANDS * BAND_ROWS)(e, np.array([100, 200]))
    two = np.concatenate([SuperMinHash(BANDS * BAND_ROWS)(e[:100], np.array([100])), SuperMinHash(BANDS * BAND_ROWS)(e[100:], np.array([200]))])
    assert (one == two).all()


def near_rows(n=150):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, 6)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
        else:
            base = rng.sample(vocabulary, rng.randrange(15, 40))
        rows.append((rng.choice("pq"), i, " ".join(base)))
    return rows + [rows[0], ("p", 900, None), ("p", 901, ""), ("q", 902, rows[0][2]), ("p", 903, rows[0][2].upper()), ("q", 904, rows[0][2] + "!")]


def brute_pairs(rows, least=18):
    sets = {}
    for t, i, x in rows:
        s = frozenset(re.findall("[a-z0-9]+", (x or "").lower()))
        if len(s) >= least:
            sets[t, i] = s
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for k, a in enumerate(keys) for b in keys[k + 1:] if a[0] == b[0] and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, id long, text string, rep int")
    found = NearDuplicates(df)
    assert {tuple(r) for r in found.pairs().collect()} == brute_pairs(rows)
    want, links = brute_pairs(rows), Counter()
    for t, a, b in want:
        links[t, a] += 1
        links[t, b] += 1
    assert {(r.table_name, r.id): r.n_links for r in found.link_counts().collect()} == dict(links)
    up = {k: k for k in links}
    for _ in links:
        for t, a, b in want:
            up[t, a] = up[t, b] = min(up[t, a], up[t, b])
    sizes = Counter(up.values())
    assert {(r.table_name, r.id): (r.group_id, r.n_records) for r in found.groups().collect()} == {k: (g[1], sizes[g]) for k, g in up.items()}


def test_near_duplicates_empty_and_many_copies(spark):
    schema = "table_name string, id long, text string"
    empty = NearDuplicates(spark.createDataFrame([], schema))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    copies = NearDuplicates(spark.createDataFrame([("p", i, text) for i in range(40)], schema))
    assert copies.pairs().count() == 40 * 39 // 2
    assert {(r.group_id, r.n_records) for r in copies.groups().collect()} == {(0, 40)}


def test_near_duplicates_take_the_greatest_text_of_an_id(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = [("p", 1, long), ("p", 1, "zzz short"), ("p", 2, long), ("p", 3, "a short"), ("p", 3, long), ("p", 4, None), ("p", 4, long)]
    assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "table_name string, id long, text string")).pairs().collect()} == {("p", 2, 3), ("p", 2, 4), ("p", 3, 4)}


def test_groups_of_many_variants_need_few_comparisons(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [("p", i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 + 1 :]])) for i in range(600)]
    found = NearDuplicates(spark.createDataFrame(rows, "table_name string, id long, text string"))
    compared = []
    verified = found.verified
    found.verified = lambda pairs: compared.append(pairs.count()) or verified(pairs)
    assert {(r.group_id, r.n_records) for r in found.groups().collect()} == {(0, 600)}
    assert sum(compared) < 6000  # of 179,700 pairs


def test_packed_keys_round_trip():
    rng = np.random.default_rng(1)
    key, num = rng.integers(-(2**63), 2**63, 5000), rng.integers(7, 60000, 5000)
    key[:50] = key[50:100]
    rows = [unpack(*r) for r in pack_keys(key, num, 64)]
    k, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    assert sorted(n.tolist()) == sorted(num.tolist()) and len(np.unique(k)) == len(np.unique(key))
    got, own = shared_keys(k, n)
    assert len(got) == 100 and sorted(own.tolist()) == sorted([*num[:50].tolist(), *num[50:100].tolist()])
    assert list(pack_keys(key[:0], num[:0], 64)) == [] and len(shared_keys(key[:0], num[:0])[0]) == 0


# --- raking --------------------------------------------------------------


def test_rake_meets_both_margins():
    row, col = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 1, 1])
    x = rake(np.array([10.0, 5.0, 3.0, 8.0, 4.0]), row, col, np.array([30.0, 50.0, 20.0]), np.array([45.0, 55.0]))
    assert np.allclose(np.bincount(row, x), [30, 50, 20], atol=1e-4)
    assert np.allclose(np.bincount(col, x), [45, 55], atol=1e-4)


def test_repair_keeps_minimums_and_size():
    targets = {"a": Target(80, 5, 100), "b": Target(15, 20, 100), "c": Target(5, 10, 100)}
    take = repair({"a": 85, "b": 12, "c": 3}, {"a": 500, "b": 30, "c": 4}, targets, 100)
    assert take == {"a": 80, "b": 20, "c": 4} or (take["b"] >= 20 and take["c"] == 4 and sum(take.values()) == max(100, 104))


def test_sample(spark):
    rng = random.Random(1)
    rows = [("s", f"id{i}", rng.choice(["A-x"] * 6 + [" b "] * 3 + ["C"]), rng.choice(["u", "v", None]), 1) for i in range(2000)]
    rows += [("s", "n1", None, "u", 1), ("s", "n2", "", "u", 1), rows[0], ("other", "z", "b", "u", 1), (None, "z", "b", "u", 1)]
    df = spark.createDataFrame(rows, "scope string, id string, category string, level string, at int")
    t = spark.createDataFrame([("s", "a_x", 50, 10, 400), ("s", "b", 30, 10, 400), ("s", "c", 15, 10, 400), ("s", "gone", 5, 10, 400)], "scope string, category string, target_pct int, min_count int, sample_size int")
    s = Sample(df, t)
    chosen = Counter(r.category for r in s.chosen.collect())
    assert sum(chosen.values()) == 400
    assert chosen["a_x"] >= 200 and chosen["b"] >= 120 and chosen["c"] >= 60
    report = {r.category: r for r in s.report().collect()}
    assert report["gone"].available == 0 and report["gone"].shortfall == 20
    assert report["a_x"].available == len({r[1] for r in rows if r[0] == "s" and r[2] == "A-x"})
    assert Counter(r.category for r in Sample(df, t).chosen.collect()) == chosen
    empty = Sample(df.limit(0), t)
    assert empty.chosen.count() == 0 and empty.report().count() == 4


def test_sample_of_many_levels_and_categories_without_share(spark):
    rows = [("s", f"i{i}", "a" if i % 7 else "b", f"level {i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "scope string, id string, category string, level string")
    t = spark.createDataFrame([("s", "a", 90, 0, 1200), ("s", "b", 0, 30, 1200), ("s", "c", None, None, 1200)], "scope string, category string, target_pct int, min_count int, sample_size int")
    got = {r.category: (r.available, r.drawn, r.shortfall) for r in Sample(df, t).report().collect()}
    assert got["c"] == (0, 0, 0) and got["b"][0] == 429 and got["b"][1] >= 30 and got["a"][1] + got["b"][1] == 1200
    assert got["a"][1] >= 1080 and got["a"][2] == 0
    levels = Counter(rows[int(r.id[1:])][3] for r in Sample(df, t).chosen.collect())
    assert len(levels) > 290 and max(levels.values()) <= 10


# --- packing -------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_never_overfills(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.choice([rng.randint(1, 60), rng.randint(1, 256)]) for _ in range(rng.choice([1, 40, 3000])))
    p = plan(dict(lengths), [16, 64, 256])
    spans = defaultdict(list)
    for n, count in lengths.items():
        box, offset = p.find(np.full(count, n), np.arange(count))
        for b, o in zip(box.tolist(), offset.tolist(), strict=True):
            spans[b].append((o, o + n))
    assert sorted(spans) == list(range(p.total))
    for b, s in spans.items():
        r = np.searchsorted(p.first, b, side="right") - 1
        s.sort()
        assert all(x[1] <= y[0] for x, y in zip(s, s[1:], strict=False))
        assert s[-1][1] <= p.tier[r]
        assert sum(e - o for o, e in s) == p.fill[r]


def test_pack_holds_every_item_once(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([5, 7, rng.randrange(1, 300)]), 0) for i in range(600)] + [(1000, 0, 0), (1001, None, 0), (3, 9, 0), (3, 9, 0)]
    items[3] = (3, 9, 0)
    df = spark.createDataFrame(items, "id long, length long, container int")
    rows = pack(df, "id", [32, 128, 128, 0, -1, None]).collect()
    size = {i: n for i, n, _ in items if n}
    assert Counter({i: sum(r["size"] for r in rows if r.id == i) for i in size}) == Counter(size)
    assert all(r["size"] == 128 or r.start + r["size"] == size[r.id] for r in rows)
    assert not any(r.piece for r in rows if size[r.id] <= 128)
    boxes = defaultdict(list)
    for r in rows:
        boxes[r.capacity, r.container].append((r.offset, r.offset + r["size"]))
    for (capacity, _), s in boxes.items():
        s.sort()
        assert s[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))
    fill = sum(size.values()) / sum(c for c, _ in boxes)
    assert fill > 0.9
    assert pack(df.limit(0), "id", [8]).count() == 0
    assert pack(df, "id", []).count() == 0


def test_steps_carry_equal_loads(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randrange(20, 60)) for i in range(2000)], "id long, length long")
    load = Counter()
    for r in pack(df, "id", [64], step=50).collect():
        load[r.step] += r["size"]
    assert max(load.values()) - min(load.values()) <= 130


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a " * 30000)], "id int, text string")
    got = {r.id: r.tokens for r in token_lengths(df, ["id"], "text").collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0)
    assert got[4] > 1 and got[5] >= 30000


# --- mixing --------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 3000])
def test_flight_keeps_totals(n):
    rng = np.random.default_rng(5)
    tokens, p = rng.integers(1, 500, n), np.where(rng.random(n) < 0.1, 1.0, 0.3)
    got = fly(tokens, p, 3)
    open_ = np.flatnonzero((got > 0) & (got < 1))
    assert len(open_) <= 2 and (got[p == 1] == 1).all()
    assert got.sum() == pytest.approx(p.sum()) and (got * tokens).sum() == pytest.approx((p * tokens).sum())
    assert (fly(tokens, p, 3) == got).all()
    landed = decide(tokens, p, 3)
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * tokens).sum() - (p * tokens).sum()) <= (3 if n > 100 else 500)
    assert abs(landed.sum() - p.sum()) <= 3


def test_flight_of_equal_items():
    got = fly(np.full(1000, 7), np.full(1000, 0.25), 1)
    assert got.sum() == pytest.approx(250) and ((got > 0) & (got < 1)).sum() <= 2


def mix_tables(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([" Big", "big", "small-one", "tiny", "extra", None]), rng.randrange(1, 200), 1) for i in range(3000)]
    rows = [r for r in rows if r[1] != "tiny" or r[0] % 10 == 0] + [(9001, "big", 0, 1), (9002, "big", None, 1), rows[0]]
    items = spark.createDataFrame(rows, "id long, source string, tokens long, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.3, 2), ("tiny", 0.2, 3), ("missing", 0.1, 2), (None, 0.1, 1), ("extra", 0.0, 1)], "source string, target_weight double, max_repeats int")
    return items, targets


def test_mixture(spark):
    items, targets = mix_tables(spark)
    m = Mixture(items, targets)
    rows = m.items.collect()
    cap = {"big": 1, "small_one": 2, "tiny": 3}
    assert all(0 < r.copies <= cap[r.source] for r in rows)
    assert len({r.id for r in rows}) == len(rows)
    total = sum(r.tokens * r.copies for r in rows)
    for source, share in (("big", 0.5), ("small_one", 0.3), ("tiny", 0.2)):
        assert sum(r.tokens * r.copies for r in rows if r.source == source) / total == pytest.approx(share, abs=0.01)
    report = {r.source: r for r in m.report().collect()}
    assert report["missing"].actual_share == 0 and set(report) == {"big", "small_one", "tiny", "missing"}
    assert report["missing"].limited and report["tiny"].limited and not report["big"].limited
    moved = Mixture(items.repartition(7, "tokens"), targets)  # neither files nor tasks matter
    assert sorted(tuple(r) for r in moved.items.collect()) == sorted(tuple(r) for r in rows)
    assert sorted(tuple(r) for r in Mixture(items, targets).items.collect()) == sorted(tuple(r) for r in rows)


def test_mixture_over_many_buckets(spark, monkeypatch):
    items, targets = mix_tables(spark)
    monkeypatch.setattr("plaza.llm.mixing.BUCKET_ROWS", 20)
    rows = Mixture(items, targets).items.collect()
    total = sum(r.tokens * r.copies for r in rows)
    for source, share in (("big", 0.5), ("small_one", 0.3), ("tiny", 0.2)):
        assert sum(r.tokens * r.copies for r in rows if r.source == source) / total == pytest.approx(share, abs=0.01)


def test_mixture_empty(spark):
    items, targets = mix_tables(spark)
    assert Mixture(items.limit(0), targets).items.count() == 0
    assert Mixture(items, targets.limit(0)).items.count() == 0
