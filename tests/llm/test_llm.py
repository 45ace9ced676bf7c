"""Packing, mixing and splitting: brute force, exact round trips, edge cases, and the SQL of their queries."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import TABLES_AT, compare, connect
from pyspark.sql import functions as F
from recall import measured

from lakeloom.llm import packing
from lakeloom.llm import queries as llm
from lakeloom.llm.mixing import Mixture, ramp_schedule
from lakeloom.llm.packing import B, K1, SKETCH, Bm25, Postings, Start, _given_out, divide, fill, items_of, pack, term_of, with_texts, words_of
from lakeloom.llm.splitting import LEVELS, Limit, blocks, split, split_documents

D = f"{TABLES_AT}/sf0.001"
WORDS = ["alpha", "beta", "gamma", "delta", "naïve", "Łódź", "データ", "👩‍🔧", "if", "x"]


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query(spark, name):
    assert compare(spark, connect(D), D, llm.QUERIES[name], llm.SQL[name]) == ""


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", ". ", "\n", "\n\n", "\r\n\r\n", "\n\n# "]) for _ in range(n))


def documents(spark, rows):
    """With columns of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "clash") for i, t, s in rows], "doc_id long, text string, source string, n_tokens int, key string")


# packing


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.integers(4, 60))
def test_divide_is_a_round_trip(t, capacity):
    data = t.encode("utf-8", "ignore")
    pieces = divide(data, capacity)
    assert b"".join(data[s : s + n] for s, n in pieces) == data
    assert all(0 < n <= capacity for _, n in pieces)
    for s, n in pieces:
        data[s : s + n].decode()
    assert all(n > capacity - 4 for _, n in pieces[:-1])


def test_words_of_scripts_without_blanks():
    assert words_of("Der Naïve_1, データ化 don't") == ["der", "naïve_1", "デ", "ー", "タ", "化", "don", "t"]
    assert len({term_of(w) for w in WORDS}) == len(WORDS)


def postings(items):
    """The index of items given as lists of whole numbers, with frequencies counted over them."""
    n, df = len(items), np.zeros(SKETCH, np.float32)
    rows = [np.unique(x, return_counts=True) for x in items]
    for t, _ in rows:
        df[t] += 1
    bm25 = Bm25(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(1.0, np.mean([len(x) for x in items])))
    item = np.repeat(np.arange(n), [len(t) for t, _ in rows])
    terms, tfs = (np.concatenate(c) for c in zip(*rows))
    return Postings(item, terms, bm25.weights(terms, tfs, np.array([len(x) for x in items])[item]), n), bm25


def test_scores_are_bm25():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(50)]
    index, bm25 = postings(items)
    for seed in (0, 7, 49):
        want = [sum(bm25.idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / bm25.mean_length)) for t, c in Counter(x.tolist()).items() if t in set(items[seed].tolist())) for x in items]
        np.testing.assert_allclose(index.scores(np.unique(items[seed])), want, rtol=1e-5)


def test_the_index_of_some_items_scores_them_alike():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(60)]
    index, _ = postings(items)
    chosen = rng.permutation(60)[:25]
    for seed in (0, 31):
        np.testing.assert_allclose(index.only(chosen).scores(np.unique(items[seed])), index.scores(np.unique(items[seed]))[chosen])


@given(st.text(st.characters(max_codepoint=127)))
def test_words_of_ascii(t):
    assert words_of(t) == packing.WORD.findall(t.lower())


@pytest.mark.parametrize("pairs", [1 << 22, 500])
def test_a_group_is_searched_as_by_brute_force(monkeypatch, pairs):
    """Of the shards a query asks the best items that fit, with all queries at a time or few; frequent words are sent as a bit each."""
    monkeypatch.setattr(packing, "PAIRS", pairs)
    monkeypatch.setattr(packing, "RANGE", 50)
    monkeypatch.setattr(packing, "HITS", 64)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 60, rng.integers(1, 30)) for _ in range(300)]
    rows, (index, bm25) = [np.unique(x, return_counts=True) for x in texts], postings(texts)
    space = packing.Space(np.arange(0, 60, 3, dtype=np.int32), np.ones(20, np.float32), 1.0, np.zeros((1, 20), np.float32))
    row, (terms, tfs) = np.repeat(np.arange(300), [len(t) for t, _ in rows]), (np.concatenate(c) for c in zip(*rows))
    words = dict(zip(packing.WORDS, packing._compacted(row, terms.astype(np.int32), tfs, 300, space)))
    units, sizes, rooms = rng.integers(0, 12, 300), rng.integers(1, 100, 300), rng.integers(0, 120, 40)
    items = packing.pa.table({"doc_id": np.arange(300), "n_tokens": sizes, "unit": packing.pa.array(units, packing.pa.int32()), **words})
    asked = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(40)]
    bits = [np.packbits(np.isin(space.heavy, texts[q])).tobytes() for q in range(40)]
    assert {len(b) for b in bits} == {3}
    queries = packing.pa.table({"limit_id": np.ones(40, np.int32), "doc_id": np.arange(40), "room": rooms, "bits": bits, "rest": words["rest"].slice(0, 40), "units": [u.astype(np.int32).tobytes() for u in asked]})
    found = packing.search_group(queries, items, space, bm25, 5).to_pylist()
    for q in range(40):
        score = index.scores(np.unique(texts[q]))
        score[(sizes > rooms[q]) | ~np.isin(units, asked[q]) | (np.arange(300) == q)] = 0
        mine = [r for r in found if r["seed"] == q]
        np.testing.assert_allclose([score[r["doc_id"]] for r in mine], [r["score"] for r in mine], rtol=1e-4)
        np.testing.assert_allclose(sorted(r["score"] for r in mine), [x for x in np.sort(score)[-5:] if x > 0], rtol=1e-4)


def test_words_as_bytes_are_the_words(spark):
    docs = spark.createDataFrame([(1, "one two two three"), (2, "two " * 50), (3, None), (4, "three four")], "doc_id long, text string")
    plain = items_of(docs, {1: 40, 2: 300}).orderBy("limit_id", "doc_id", "piece_no").toArrow()
    space = packing.Space(np.sort(np.array([term_of("two"), term_of("never")], np.int32)), np.ones(2, np.float32), 1.0, np.zeros((1, 2), np.float32))
    got = items_of(docs, {1: 40, 2: 300}, space, compact=True).orderBy("limit_id", "doc_id", "piece_no").toArrow()
    offsets, terms, tfs = packing._words(got, space)
    for i, (want, n) in enumerate(zip(plain["terms"].to_pylist(), plain["tfs"].to_pylist())):
        assert (got["rest"][i].as_py() is None) == (want is None)
        assert dict(zip(terms[offsets[i] : offsets[i + 1]], tfs[offsets[i] : offsets[i + 1]])) == dict(zip(want or (), n or ()))


def test_containers_are_full_or_nothing_fits():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 100, 300)
    items = [rng.integers(0, 500, 10) for _ in range(300)]
    terms = [np.unique(x) for x in items]
    opened = [(terms[0], 35), (terms[1], 0)]
    before, new = fill(postings(items)[0], sizes, terms, 100, opened)
    assert sorted(i for c in [*before, *new] for i in c) == list(range(300))
    rooms = [room - sizes[c].sum() for (_, room), c in zip(opened, before)] + [100 - sizes[c].sum() for c in new]
    assert min(rooms) >= 0
    for k, room in enumerate(rooms[:-1]):
        later = [i for c in [*before, *new][k + 1 :] for i in c]
        assert all(sizes[i] > room for i in later)


def test_neighbours_come_first():
    """The seed takes the item that shares its words though others fit as well."""
    terms = [[1, 2, 3], [9, 9, 9], [7, 8, 9], [1, 2, 4]]
    assert fill(postings(terms)[0], np.array([60, 40, 40, 40]), [np.unique(x) for x in terms], 100)[1][0] == [0, 3]


def test_an_item_goes_to_the_best_query_with_room():
    # pairs from the best down: item 0 to query 0, which is full then, so item 1 goes to query 1
    assert _given_out(np.array([0, 1, 1, 0, 2]), np.array([0, 0, 1, 1, 1]), np.array([5, 5, 5]), np.array([7, 6])) == [0, 2]


def test_seeds_are_the_largest_and_enough(spark):
    start = Start.of({10: 100, 6: 50, 1: 30, 0: 9}, 20)  # 1330 tokens, 67 containers
    assert start.size == 10 and start.share == 0.67 and start.edges == [1, 6, 10]
    assert Start.of({0: 5}, 10).size == 0 and Start.of({}, 10).edges == []


def test_pack_holds_every_text_whole(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.choice([1, 3, 10, 40])), None) for i in range(300)]
    rows += [(1000, None, None), (1001, "", None), (1002, text(rng, 2000), None), (1003, rows[0][1], None), (1004, "é" * 400, None), (1005, " \n ", None)]
    rows += [(2000 + i, "the very same words again", None) for i in range(150)]  # a third alike
    docs = documents(spark, rows)
    limits = {7: 256, 3: 2048}
    got = with_texts(pack(docs, limits, group=50, block=20, part=100), docs).collect()
    for limit_id, capacity in limits.items():
        by_doc, by_container = defaultdict(list), defaultdict(list)
        for r in got:
            if r.limit_id == limit_id:
                by_doc[r.doc_id].append(r)
                by_container[r.container_id].append(r)
        for i, t, _ in rows:
            pieces = sorted(by_doc[i], key=lambda r: r.piece_no)
            assert [r.piece_no for r in pieces] == list(range(pieces[0].pieces))
            assert (t is None and pieces[0].text is None) or "".join(r.text for r in pieces) == t
            assert len(pieces) == 1 or len(t.encode()) > capacity
        for c in by_container.values():
            assert sum(r.n_tokens for r in c) == c[0].container_tokens == capacity - c[0].unused <= capacity
            assert sorted(r.position for r in c) == list(range(len(c)))
        total = sum(len((t or "").encode()) for _, t, _ in rows)
        assert len(by_container) <= total / capacity * 1.1 + 10


def test_filling_walks_no_postings_of_frequent_terms(monkeypatch):
    """Their scores are a matrix product for many containers; only the other terms' postings are looked at for each container."""
    walked, postings_of = [], Postings.postings
    monkeypatch.setattr(Postings, "postings", lambda self, query, at: walked.append(self.count[at].sum()) or postings_of(self, query, at))
    rng = np.random.default_rng(6)
    items = [np.append(rng.choice(30, 15, replace=False), 1000 + i // 2) for i in range(400)]  # half of 30 terms, and one that two items have
    new = fill(postings(items)[0], np.full(400, 20), [np.unique(x) for x in items], 100)[1]
    assert sorted(i for c in new for i in c) == list(range(400)) and {len(c) for c in new} == {5}
    assert sum(walked) <= 2 * len(new)


@pytest.mark.parametrize("near", [1, 90, 700])
def test_scores_finished_for_few_queries_at_a_time_are_the_same(monkeypatch, near):
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 30)), return_counts=True) for _ in range(300)]
    _, bm25 = postings([np.repeat(*x) for x in rows])
    space = packing.Space(np.arange(0, 60, 3, dtype=np.int32), np.ones(20, np.float32), 1.0, np.zeros((1, 20), np.float32))
    row, (terms, tfs) = np.repeat(np.arange(300), [len(t) for t, _ in rows]), (np.concatenate(c) for c in zip(*rows))
    words = dict(zip(packing.WORDS, packing._compacted(row, terms.astype(np.int32), tfs, 300, space)))
    items = packing.pa.table({"doc_id": np.arange(300), "n_tokens": rng.integers(1, 100, 300), "unit": packing.pa.array(rng.integers(0, 12, 300), packing.pa.int32()), **words})
    bits = [np.packbits(np.isin(space.heavy, rows[q][0])).tobytes() for q in range(40)]
    units = [np.sort(rng.choice(14, rng.integers(0, 6), replace=False)).astype(np.int32).tobytes() for _ in range(40)]  # none, or some that the group hasn't
    queries = packing.pa.table({"limit_id": np.ones(40, np.int32), "doc_id": np.arange(40), "room": rng.integers(0, 120, 40), "bits": bits, "rest": words["rest"].slice(0, 40), "units": units})
    for give_out in (False, True):
        want = packing.search_group(queries, items, space, bm25, 5, give_out)
        with monkeypatch.context() as m:
            m.setattr(packing, "NEAR", near)
            got = packing.search_group(queries, items, space, bm25, 5, give_out)
        assert want.num_rows and got.equals(want)


def test_shards_of_equal_promise_are_asked_in_their_order():
    """Seeds without frequent words may ask any shard, here 500 of ten items each, and ask the first."""
    space = packing.Space(np.arange(4, dtype=np.int32), np.ones(4, np.float32), 1.0, np.eye(4, dtype=np.float32))
    zeros = np.zeros(500, np.int64)
    routes = {"limit": zeros + 1, "cluster": zeros, "n": zeros + 10, "fit": np.ones(500), "low": zeros, "pieces": zeros + 1, "group0": zeros, "reach": {1: 95}}
    words = {"heavy": [b""] * 3, "rest": [np.arange(200, dtype=np.int32).tobytes()] * 3}
    batch = packing.pa.table({"limit_id": np.ones(3, np.int32), "doc_id": np.arange(3), "room": np.full(3, 50), **words}).to_batches()[0]
    got = [r for b in packing._route(batch, routes, space) for r in b.to_pylist()]
    assert [np.frombuffer(r["units"], np.int32).tolist() for r in got] == [list(range(10))] * 3


@given(st.text(st.sampled_from("aAÀßẞİKſς_ -.\n\t٣デ漢👩\u200d\x1c\u3000\u0345"), max_size=30))
def test_words_are_counted_as_they_are_found(t):
    assert packing._counted(t) == Counter(words_of(t))


@pytest.mark.parametrize("settings", [{}, {"group": 700}])
def test_the_index_finds_nine_of_ten_neighbours(spark, settings):
    """Against brute force over all items, whole and with shards that are cut."""
    found = measured(spark, spark.read.parquet(f"{TABLES_AT}/sf0.1/documents.parquet"), 2048, **settings)
    assert min(found.values()) >= 0.9


@pytest.mark.parametrize("group", [10_000, 40])
def test_pack_in_one_group_and_in_many(spark, group):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40))), None) for i in range(400)]
    got = pack(documents(spark, rows), {1: 400}, group=group).collect()
    assert sorted(r.doc_id for r in got) == list(range(400)) and min(r.unused for r in got) >= 0
    assert len({r.container_id for r in got}) <= sum(len(t) for _, t, _ in rows) / 400 * 1.1 + 2


def test_pack_of_nothing(spark):
    docs = documents(spark, [])
    assert pack(docs, {1: 100}).count() == 0 and pack(docs, {}).count() == 0
    only_empty = pack(documents(spark, [(1, None, None), (2, "", None)]), {1: 100}).collect()
    assert {r.doc_id for r in only_empty} == {1, 2} and all(r.unused == 100 for r in only_empty)
    alike = pack(documents(spark, [(i, "same", None) for i in range(50)]), {1: 10}).collect()
    assert sorted(r.doc_id for r in alike) == list(range(50)) and len({r.container_id for r in alike}) == 25


# mixing

TARGETS = "mix_id int, source_key string, target_share double, max_repeats int"


def mixture(spark, rows, targets, schedule=None):
    t = spark.createDataFrame(targets, TARGETS)
    return Mixture(documents(spark, rows), t, ramp_schedule(t) if schedule is None else schedule)


def test_mix_reaches_shares_and_caps_repeats(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(1, 60), rng.choice(["Big", " big "])) for i in range(2000)]
    rows += [(5000 + i, "y" * 30, "small") for i in range(100)] + [(6000, None, "small"), (6001, "", "small"), (6002, "zzz", None), (6003, "q" * 50, "untargeted")]
    total = sum(len(t or "") for _, t, _ in rows)
    targets = [(1, "big", 0.6, 1), (1, "SMALL", 0.2, 3), (1, "nobody", 0.1, 2), (1, "big", 0.6, 1), (2, "small", 1.0, 2), (2, "big", None, None)]
    m = mixture(spark, rows, targets)
    shares = {(r.mix_id, r.source_key): r for r in m.shares().collect()}
    assert len(shares) == 5
    big, small = shares[1, "big"], shares[1, "small"]
    assert abs(big.used_tokens - 0.6 * total) <= 60 and not big.exhausted
    assert small.exhausted is (3 * 3000 < 0.2 * total) and small.used_tokens == min(9000, small.used_tokens)
    assert shares[1, "nobody"].exhausted and shares[1, "nobody"].used_tokens == 0
    assert shares[2, "small"].exhausted and shares[2, "small"].used_tokens == 6000 and shares[2, "small"].uses == 200
    assert shares[2, "big"].used_tokens == 0 and not shares[2, "big"].exhausted
    assert abs(sum(r.actual_share for (mix, _), r in shares.items() if mix == 1) - 1) < 1e-9
    uses = Counter((r.mix_id, r.doc_id) for r in m.sequence().collect())
    assert max(n for (mix, i), n in uses.items() if mix == 1 and 5000 <= i < 6000) <= 3
    assert max(n for (mix, i), n in uses.items() if mix == 1 and i < 2000) == 1
    assert not {6000, 6001, 6002, 6003} & {i for _, i in uses}


@pytest.mark.parametrize("points", [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 2.0)], [(0.0, 2.0), (0.5, 0.0), (1.0, 2.0)]])
def test_positions_follow_the_schedule(spark, points):
    """By any time t the tokens used are the integral of the schedule up to t."""
    rows = [(i, "w" * 10, "s") for i in range(1000)]
    schedule = spark.createDataFrame([(1, "s", t, w) for t, w in points], "mix_id int, source_key string, t double, weight double")
    positions = sorted(r.position for r in mixture(spark, rows, [(1, "s", 1.0, 1)], schedule).sequence().collect())
    assert len(positions) == 1000
    area = lambda upto: sum((min(b, upto) - a) * (w + (w + (v - w) * (min(b, upto) - a) / (b - a))) / 2 for (a, w), (b, v) in zip(points, points[1:]) if upto > a)
    for t in (0.1, 0.35, 0.5, 0.8, 1.0):
        assert abs(sum(p <= t for p in positions) / 1000 - area(t) / area(1.0)) < 0.002


def test_layout_is_a_running_sum(spark):
    rows = [(i, "x" * (i % 7), "s") for i in range(500)]
    laid = sorted((r.start, r.n_tokens) for r in mixture(spark, rows, [(1, "s", 1.0, 1)]).laid_out().collect())
    at = 0
    for start, n in laid:
        assert start == at
        at += n
    assert at == sum(i % 7 for i in range(500))


def test_unreached_targets_are_those_of_the_sequence(spark, monkeypatch):
    rows = [(i, "x" * 10, "s") for i in range(100)] + [(200, "y" * 1000, "big")]
    targets = [(1, "s", 0.5, 1), (2, "s", 0.6, 1), (3, "s", 0.6, 2), (4, "nobody", 0.1, 1), (5, "big", 0.0001, 1), (6, "s", 0.1, 0), (7, "s", 0.0, 1)]
    written = []
    monkeypatch.setattr("lakeloom.llm.mixing.materialize", lambda df, label: written.append((label, df.columns)) or df)
    m = mixture(spark, rows, targets)
    assert sorted(map(tuple, m.unreached().collect())) == [(2, "s"), (4, "nobody"), (6, "s")]
    assert any(label == "sequence" and "position" in columns for label, columns in written)


def test_mix_of_nothing(spark):
    m = mixture(spark, [], [(1, "s", 1.0, 1)])
    assert m.sequence().count() == 0 and m.ordered().count() == 0
    assert [(r.used_tokens, r.exhausted) for r in m.shares().collect()] == [(0, False)]


def test_training_order_is_sorted(spark):
    rows = [(i, "x" * 9, "s") for i in range(200)]
    order = [(r.mix_id, r.position) for r in mixture(spark, rows, [(1, "s", 1.0, 2), (2, "s", 0.5, 1)]).ordered().collect()]
    assert order == sorted(order) and len({m for m, _ in order}) == 2


# splitting


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*WORDS, " ", "\n", "\r\n", "\n\n", "# ", ". ", "。", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]), max_size=120), st.integers(12, 80), st.integers(0, 7))
def test_split_is_a_round_trip(parts, most, overlap):
    data = "".join(parts).encode()
    pieces, long_blocks = split(data, Limit(1, most, overlap))
    assert b"".join(data[s + o : e] for s, e, o, _ in pieces) == data
    for k, (s, e, o, _) in enumerate(pieces):
        assert e - s <= most
        data[s:e].decode()
        if k:
            before = pieces[k - 1]
            assert s + o == before[1] and min(overlap - 3, before[1] - before[0]) <= o <= overlap
    own = blocks(data)
    assert long_blocks == [i for i, (s, e, _) in enumerate(own) if e - s > most]


def test_cuts_are_as_coarse_as_they_can_be():
    data = b"# one\n\nfirst part here\n\n# two\n\nsecond part, first line\nsecond line. And a sentence"
    pieces, _ = split(data, Limit(1, 40))
    assert [(data[s:e], LEVELS[level]) for s, e, _, level in pieces[:2]] == [(b"# one\n\nfirst part here\n\n# two\n\n", "paragraph"), (b"second part, first line\n", "line")]
    assert [(s, e, LEVELS[level]) for s, e, _, level in split(data, Limit(1, 60))[0]] == [(0, 24, "section"), (24, len(data), "section")]
    words = b"one two three four five"
    assert [words[s:e] for s, e, _, _ in split(words, Limit(1, 10))[0]] == [b"one two ", b"three ", b"four five"]
    assert [e - s for s, e, _, _ in split(b"x" * 25, Limit(1, 10, 3))[0]] == [7, 10, 10, 7]


def test_blocks_count_only_non_empty_parts():
    assert [(s, e) for s, e, _ in blocks(b"\n\nab\r\n\ncd\n \nef\n\n\n")] == [(2, 4), (7, 14)]
    assert blocks(b"") == [] and blocks(b"\n\n\n") == []


def test_split_documents(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, rng.choice([1, 30, 200])), None) for i in range(60)] + [(100, None, None), (101, "", None), (102, "é" * 5000, None), (103, "a b " * 50_000, None)]
    limits = [Limit(3, 300, 20), Limit(4, 1500, 100)]
    got = defaultdict(list)
    for r in split_documents(documents(spark, rows), limits).collect():
        got[r.limit_id, r.doc_id].append(r)
    for limit in limits:
        for i, t, _ in rows:
            pieces = sorted(got[limit.limit_id, i], key=lambda r: r.piece_no)
            if len((t or "").encode()) <= limit.max_tokens:
                assert not pieces
                continue
            assert "".join(r.text.encode()[r.overlap_tokens :].decode() for r in pieces) == t
            assert all(len(r.text.encode()) == r.n_tokens <= limit.max_tokens for r in pieces)
            assert pieces[-1].cut_at == "end"
    assert split_documents(documents(spark, []), limits).count() == 0
    assert split_documents(documents(spark, rows), []).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        Limit(1, 10, 10)


def test_whole_queries(spark):
    containers = llm.p6_containers(spark, D)
    assert containers.filter("unused < 0").count() == 0
    n = spark.read.parquet(f"{D}/documents.parquet").count()
    assert containers.select("limit_id", "doc_id").distinct().count() == 2 * n
    shares, used = llm.p7_shares(spark, D), llm.p7_sequence(spark, D)
    assert shares.agg(F.sum("uses")).first()[0] == used.count()
    assert llm.p8_pieces(spark, D).filter("overlap_tokens = 0 and piece_no > 0").count() == 0
