"""Small tables with nulls, empties, long texts, repeats and clashing extra columns, each operator against brute force."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqloom.llm import extract, minhash, mixing, multi_index, packing, pitman_yor, pu_quality, quality_rules, run_index, warc
from seqloom.llm.common import components

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 9))) for _ in range(900)]
PLAIN = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, _w string, kept string"


def prose(n, r=R):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def texts():
    base = [prose(R.randint(20, 200)) for _ in range(40)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    passage = prose(60)
    shared = [prose(40) + " " + passage + " " + prose(40) for _ in range(4)]
    odd = [None, "", "one", "one", " \n\t", "Two Words", "é" * 500, "x" * 50_000, prose(6000), "the cat " * 300, "a\n" * 90, "#$% | " * 60, "\x1c odd\x0bspace", "a <|endoftext|> b<|endoftext|><|endoftext|>  c", "<|endoftext|>"]
    return base + base[:5] + near + shared + odd


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i if i != 3 else None, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", None, i, 2, "w", "k") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, PLAIN)


@pytest.fixture(scope="module")
def docs(spark):
    d = frame(spark)
    return d.union(d.where("doc_id = 5")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).where("false")


def union_find(pairs):
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def test_components(spark):
    pairs = [(R.randint(0, 300), R.randint(0, 300)) for _ in range(200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == {k: min(x for x in want if want[x] == v) for k, v in want.items()}


def test_language_model(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    count = collections.Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            count.update([*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    got = pitman_yor.score(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        g = by[d]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert g.score <= 0
    assert sum(g.score for g in got if not g.held_out) > sum(g.base_score for g in got if not g.held_out)
    assert pitman_yor.score(empty).count() == 0


def test_contexts_are_whole_words(spark):
    """Words with one ending are contexts of their own, in one partition: what follows each is nearly certain."""
    words = ["walking", "talking", "king", "looking"]
    c, w, at, sizes = pitman_yor.pairs_of(pa.array([" ".join(f"{x} then" for x in words), None]))
    c, w = c[at], w[at]
    assert len(set(c.tolist())) == len(words) + 2 and c[0] == c[-1] == 0 and w[-1] == w[-2] == pitman_yor.END and sizes.tolist() == [9, 1]
    assert len({int(x) >> 40 for x in c[1:-1:2]}) == 1 and len({int(x) for x in c[1:-1:2]}) == len(words)
    rows = [(i, " ".join(f"{a} next{k}" for k, a in enumerate(words)), "x") for i in range(400)]
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(g.score / g.n_tokens > -0.05 for g in got)


def test_words_of_many_texts():
    texts_ = [t for t in texts() if t is None or len(t) < 20_000] + [" a", "a ", "\n\x0b\x0cB\tÀb\r", "\x1fa\x85b\u00a0c"]
    c, w, at, sizes = pitman_yor.pairs_of(pa.array(texts_, pa.string()))
    end = 0
    for t, n in zip(texts_, sizes.tolist()):
        words = (t or "").encode().lower().split()
        own = [pitman_yor.xxhash.xxh3_64_intdigest(x) for x in words]
        assert w[at[end : end + n]].tolist() == [*own, pitman_yor.END]
        low = c[at[end : end + n]].tolist()
        assert low[0] == 0 and [x & (1 << 40) - 1 for x in low[1:]] == [x & (1 << 40) - 1 for x in own]
        assert [x >> 40 for x in low[1:]] == [pitman_yor.xxhash.xxh3_64_intdigest(x[-3:]) >> 40 for x in words]
        end += n
    assert end == len(at)


@pytest.mark.parametrize("few", [1, 64, 10_000])
def test_seating_of_one_after_the_other(few, monkeypatch):
    monkeypatch.setattr(pitman_yor, "FEW", few)
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 5000])
    t = pitman_yor.seat(c, np.full(5, 0.5), 0.5, rng)
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0
    p = np.zeros(41)  # of the number of tables
    p[1] = 1
    for j in range(1, 40):
        new = 0.7 / (0.7 + j - 0.4 * np.arange(41))
        p = p * (1 - new) + np.concatenate([[0], (p * new)[:-1]])
    t = pitman_yor.seat(np.full(4000, 40), np.full(4000, 0.7), 0.4, rng)
    assert t.mean() == pytest.approx(p @ np.arange(41), rel=0.05)


def partitions(n):
    """All ways to seat n customers, as lists of table sizes."""
    if not n:
        yield []
        return
    for sizes in partitions(n - 1):
        yield [*sizes, 1]
        for i in range(len(sizes)):
            yield [*sizes[:i], sizes[i] + 1, *sizes[i + 1 :]]


def test_moves_leave_the_posterior_as_it_is():
    """Restaurants of two dishes, 4 and 3 customers, against all their seatings."""
    a, d, h = 0.8, 0.4, np.array([0.3, 0.1])
    weight = collections.Counter()
    for x in partitions(4):
        for y in partitions(3):
            size = lambda k: math.prod(i - d for i in range(1, k))
            t = len(x) + len(y)
            weight[len(x), len(y)] += math.prod(a + d * i for i in range(t)) * h[0] ** len(x) * h[1] ** len(y) * math.prod(map(size, x + y))
    total = sum(weight.values())
    k = 3000
    tables = pitman_yor.Tables(np.tile([4, 3], k))
    rng = np.random.default_rng(5)
    dish = np.arange(2 * k)
    for _ in range(60):
        for part in (0, 1):  # one dish of a restaurant at a time
            live = dish[dish % 2 == part]
            own = np.bincount(dish // 2, tables.t)[live // 2]
            tables.move(live, lambda closed: (a + d * (own - closed)) * h[part], d, rng)  # noqa: B023
            assert (np.bincount(np.repeat(dish, tables.t), tables.sizes) == tables.n).all()
    got = collections.Counter(map(tuple, tables.t.reshape(-1, 2).tolist()))
    for key, w in weight.items():
        assert abs(got[key] / k - w / total) < 0.04, key


def test_probabilities_after_a_context_add_up_to_one():
    """The operator's own state, with every word of the vocabulary and an unknown one asked for after every context."""
    rng = np.random.default_rng(3)
    contexts = np.sort(np.array([(g << 40) + u for g in range(3) for u in range(4)], np.uint64))
    v = 31
    c, w = np.repeat(contexts, v), np.tile(np.arange(v, dtype=np.uint64) + 5, len(contexts))
    n = rng.poisson(0.7, len(c)) ** 2
    n[c == contexts[-1]] = 0  # a context without training
    n[w == w[v - 1]] = 0  # the unknown word
    packed = [pitman_yor.pack_sorted(w[:v]), pitman_yor.pack(np.tile(np.arange(v), len(contexts)).astype(np.uint32)), pitman_yor.pack_sorted(contexts), pitman_yor.pack(np.full(len(contexts), v, np.uint32)), pitman_yor.pack(n.astype(np.uint64))]
    s = pitman_yor.State(*packed)
    model = pitman_yor.Model((1.0, 2.0, 0.5), (0.7, 0.5, 0.4), 0.0, 0.0, v - 1, int(n.sum()))
    for _ in range(6):
        c0 = np.bincount(s.word, s.high, v)
        r0 = pitman_yor.seat(c0, np.full(v, 0.3), 0.4, rng)
        model = model._replace(customers=c0.sum(), tables=r0.sum())
        root = model.root(c0, r0)
        assert root.sum() == pytest.approx(1, abs=1e-12)
        for _ in range(2):
            s.sweep(model, root, rng)
            p = s.predictive(model, root).reshape(len(contexts), v)
            assert (p > 0).all() and np.abs(p.sum(1) - 1).max() < 1e-12
        sizes, high = pitman_yor.pack(s.low.sizes.astype(np.uint64)), pitman_yor.pack(s.high.astype(np.uint64))
        again = pitman_yor.State(*packed, sizes, high)
        assert (again.low.t == s.low.t).all() and np.allclose(again.predictive(model, root), s.predictive(model, root))
        levels = s.report(0, 2, model)[-1][-1]
        (a, d), (a1, d1) = pitman_yor.inferred(levels[:4]), pitman_yor.inferred(levels[4:])
        assert a > 0 < a1 and 0 < d < 1 and 0 < d1 < 1


def test_a_sweep_moves_every_customer():
    """One sweep of a restaurant that starts with a table a dish: the large dishes split as the posterior has it."""
    v = 130
    n = np.where(np.arange(v) < 100, 30, 2000)  # side by side, and one dish after the other
    packed = [pitman_yor.pack_sorted(np.arange(v, dtype=np.uint64)), pitman_yor.pack(np.arange(v).astype(np.uint32)), pitman_yor.pack_sorted(np.zeros(1, np.uint64)), pitman_yor.pack(np.array([v], np.uint32)), pitman_yor.pack(n.astype(np.uint64))]
    s = pitman_yor.State(*packed)
    model = pitman_yor.Model((100.0, 2.0, 0.5), (0.5, 0.5, 0.4), float(v), float(v), v, int(n.sum()))
    rng = np.random.default_rng(1)
    got = []
    for _ in range(20):
        s.sweep(model, np.full(v, 1 / v), rng)
        assert (np.bincount(np.repeat(s.low.dish, s.low.t), s.low.sizes) == n).all()
        got.append((s.t[:100].mean(), s.t[100:].mean()))
    late = np.mean(got[10:], axis=0)
    assert (np.array(got[0]) > late / 2).all()


@pytest.mark.parametrize(("side", "near"), [(256, 64), (4, 2)])
def test_tables_of_a_dish_are_drawn_together(side, near, monkeypatch):
    """All dishes at once or one by one: numbers of tables and expected sums against all seatings of 7 customers."""
    monkeypatch.setattr(pitman_yor, "SIDE", side)
    d, pull, n, k = 0.6, 1.5, 7, 4000
    p, own = np.zeros(n + 1), np.zeros(n + 1)
    for x in partitions(n):
        w = pull ** len(x) * math.prod(j - d for size in x for j in range(1, size))
        p[len(x)] += w
        own[len(x)] += w * sum(1 / (j - d) for size in x for j in range(1, size))
    t, sums = pitman_yor.draw(np.full(k, n), np.full(k, pull), d, np.random.default_rng(4), near)
    assert np.abs(np.bincount(t, minlength=n + 1) / k - p / p.sum()).max() < 0.03
    assert sums == pytest.approx(own[t] / p[t])


def test_later_sweeps_draw_small_dishes(monkeypatch):
    """No dish of up to DIRECT customers is moved customer by customer once it is seated."""
    v, n = 70, np.full(70, 3000)
    packed = [pitman_yor.pack_sorted(np.arange(v, dtype=np.uint64)), pitman_yor.pack(np.arange(v).astype(np.uint32)), pitman_yor.pack_sorted(np.zeros(1, np.uint64)), pitman_yor.pack(np.array([v], np.uint32)), pitman_yor.pack(n.astype(np.uint64))]
    s, rng = pitman_yor.State(*packed), np.random.default_rng(2)
    model = pitman_yor.Model((10.0, 2.0, 0.5), (0.5, 0.5, 0.4), float(v), float(v), v, int(n.sum()))
    s.sweep(model, np.full(v, 1 / v), rng)
    moves = []
    for name in ("move", "move_one"):
        monkeypatch.setattr(pitman_yor.Tables, name, lambda *x, f=getattr(pitman_yor.Tables, name): moves.append(1) or f(*x))
    before = s.t.copy()
    s.sweep(model, np.full(v, 1 / v), rng)
    assert not moves and (s.t != before).any() and (s.t <= n).all()


def test_auxiliary_variables_of_old_tables():
    """Of all tables of a dish, against all ways to seat 12 customers one after the other."""
    d, pull, n, k = 0.6, 1.5, 12, 6000
    p, want = {1: 1.0}, 0.0
    for j in range(1, n):
        to = collections.Counter()
        for t, x in p.items():
            room = j - d * t
            want += x * room / (room + pull) * t * (1 - d) / room
            to[t] += x * room / (room + pull)
            to[t + 1] += x * pull / (room + pull)
        p = to
    for few in (np.full(k, n), np.full(30, n)):  # side by side, and one dish after the other
        old = []
        for _ in range(k // len(few)):
            pitman_yor.seat(few, np.full(len(few), pull), d, np.random.default_rng(_), old)
        assert sum(old) / k == pytest.approx(want, rel=0.02)


def test_rounds_go_on_until_the_tables_settle(spark, monkeypatch):
    """A corpus whose tables still change after two rounds."""
    r = random.Random(8)
    docs = spark.createDataFrame([(i, prose(r.randint(20, 120), r)) for i in range(400)], "doc_id long, text string")
    rounds, tables, one, sure = [], [], pitman_yor._round, pitman_yor.settled
    monkeypatch.setattr(pitman_yor, "_round", lambda *x: rounds.append(x[1]) or one(*x))
    monkeypatch.setattr(pitman_yor, "settled", lambda *x: tables.append(x) or sure(*x))
    assert all(x.score < 0 for x in pitman_yor.score(docs).collect())
    assert rounds == list(range(len(rounds))) and len(rounds) > 2
    for before, now in tables:
        assert all(abs(y - x) <= max(0.01 * x, 3 * math.sqrt(x)) for x, y in zip(before, now)) == (now is tables[-1][1])
    assert not pitman_yor.settled([1e6, 1e6, 1e6], [1e6, 1e6, 1.02e6])


def test_no_pair_comes_twice(spark):
    """A partition without a dish of two customers, as small ones have in a large corpus."""
    rows = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, None)], "doc_id long, text string")
    assert all(r.score < 0 and r.n_tokens for r in pitman_yor.score(rows.where("doc_id < 3")).collect())
    assert pitman_yor.unpack(pitman_yor.pack(np.zeros(0, np.uint64)), np.uint64).tolist() == []


def test_shards_of_a_partition(spark, tmp_path):
    """A partition in shards: rows of the same counts, probabilities after a context that add up to 1 over all shards."""
    docs = spark.createDataFrame([(i, prose(40)) for i in range(300)], "doc_id long, text string")
    one, many = ({r.doc_id: r for r in pitman_yor.score(docs, k).collect()} for k in (1 << 40, 500))
    for i, r in one.items():
        assert r[:6] == pytest.approx(many[i][:6], rel=1e-12) and r.score == pytest.approx(many[i].score, rel=0.05)
    text_ = pa.table({"text": pa.array([prose(200) for _ in range(20)]), "held_out": [False] * 20, "chunk": pa.array([0] * 20, pa.int32())})
    asks = pitman_yor._count(1)(text_).to_batches()
    for b in pitman_yor._merge(200)(iter(asks)):
        (tmp_path / f"part=0/shard={b['shard'][0]}").mkdir(parents=True)
        pq.write_table(pa.Table.from_batches([b]), tmp_path / f"part=0/shard={b['shard'][0]}/x.parquet")
    p, rng = pitman_yor.Part(f"file://{tmp_path}", 0), np.random.default_rng(0)
    assert len(p.shards) > 2
    vocab = {k: p.get(k).vocab for k in p.shards}
    words = np.unique(np.concatenate(list(vocab.values())))
    model = pitman_yor.Model((1.0, 2.0, 0.5), (0.7, 0.5, 0.4), 0.0, 0.0, len(words), 0)
    roots = {k: np.full(len(v), 1 / len(words)) for k, v in vocab.items()}
    for _ in range(3):
        for k in p.shards:
            s = p.get(k)
            s.sweep(model, roots[k], rng)
            p.put(k, s)
    whole = collections.Counter()
    for k in p.shards:
        s = p.get(k)
        assert (s.n == p.read(k).n).all() and len(set(zip(s.ctx.tolist(), s.w.tolist()))) == len(s.n)
        for c, x in zip(s.names[s.ctx].tolist(), s.predictive(model, roots[k]).tolist()):
            whole[c] += x
    # the words that a context was not asked for have their parent's share
    a, d = model.strength[0], model.discount[0]
    for i, c in enumerate(p.names.tolist()):
        e = int(np.searchsorted(p.ending_names, c >> 40))
        a1, d1 = model.strength[1], model.discount[1]
        rest = 0.0
        for k in p.shards:
            s = p.get(k)
            parent = (a1 + d1 * p.high_tables[e]) * roots[k] / (a1 + p.customers[e])
            at = np.searchsorted(s.ending_names, c >> 40)
            if at < s.endings and s.ending_names[at] == c >> 40:
                mine = s.ending == at
                parent[s.word[mine]] = s.parent(model, roots[k])[mine]
            ctx = np.searchsorted(s.names, c)
            asked = s.w[s.ctx == ctx] if ctx < s.contexts and s.names[ctx] == c else []
            parent[asked] = 0
            # a word of several shards' vocabularies is in one shard only
            rest += parent.sum()
        assert whole[c] + (a + d * p.tables[i]) * rest / (a + p.total_n[i]) == pytest.approx(1, abs=1e-9)


def test_digamma():
    x = np.array([0.1, 1.0, 3.5, 40.0])
    h = 1e-5
    assert pitman_yor._digamma(x) == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / 2 / h for v in x], abs=1e-5)


def test_repeated_documents_score_higher(spark):
    """The model learns what comes twice: the same text, once held out alone and once also in training."""
    base = [prose(60) for _ in range(80)]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 10]
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    once, twice = prose(60), prose(60)
    rows = [*zip(free[:80], base), (held[0], once), (held[1], twice), (free[81], twice)]
    got = {r.doc_id: r.score / r.n_tokens for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[1]] > got[held[0]] + 0.3


def test_vectors(spark, docs):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    x[50:120] = x[:1] + r.normal(scale=0.05, size=(70, 8))
    x[120:130] = x[130:140]
    rows = [(i, [float(v) for v in y], 1, "x") for i, y in enumerate(x)]
    rows += [(300, None, 0, "x"), (301, [0.0] * 8, 0, "x"), (302, [float("nan")] + [1.0] * 7, 0, "x"), (303, [None] + [1.0] * 7, 0, "x"), (304, [], 0, "x"), (None, rows[0][1], 0, "x")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string")
    got = {g.vec_id: g for g in multi_index.near_duplicates(t).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = union_find([(int(a), int(b)) for a, b in zip(*np.nonzero(link))])
    found = sum(got[i].n_links for i in range(300))
    assert found <= link.sum() and found >= 0.97 * link.sum()
    assert sum(got[i].component_id == comp.get(i, i) for i in range(300)) >= 295
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(300, 305)) and got[None].kept
    assert multi_index.near_duplicates(t.where("false")).count() == 0


def test_rare_links_beyond_the_sample(spark, monkeypatch):
    """Pairs at the threshold, of which a sample has next to none with both ends."""
    monkeypatch.setattr(multi_index, "SAMPLE", 300)
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = r.normal(size=(300, 16))
    u -= (u * x[:300]).sum(1, keepdims=True) * x[:300]
    x[300:600] = 0.905 * x[:300] + math.sqrt(1 - 0.905**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    t = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    assert links.sum() >= 600
    got = {g.vec_id: g.n_links for g in multi_index.near_duplicates(t).collect()}
    assert 0.999 * links.sum() <= sum(got.values()) <= links.sum()
    assert all(got[i] <= n for i, n in enumerate(links.sum(1)))


def test_trees_of_links():
    r = np.random.default_rng(8)
    for k in (0, 5, 60, 400):
        u, v = r.integers(0, 200, k), r.integers(0, 200, k)
        root = np.arange(200)
        for at in range(0, k, 37):
            multi_index.unite(root, u[at : at + 37], v[at : at + 37])
        want = union_find(list(zip(u.tolist(), v.tolist())))
        assert root.tolist() == [min((x for x in want if want[x] == want[i]), default=i) if i in want else i for i in range(200)]


def test_visits_and_their_test_agree():
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(400, 6)))  # many equal distances
    index = multi_index.Index(x, 4000)
    index.visits = 37
    cells, far = index.cells(x)
    for cell in range(len(index.books[0]) * len(index.books[1])):
        d = index.far(x, np.full(len(x), cell))
        comes = (d < far[:, -1]) | ((d == far[:, -1]) & (cell <= cells[:, -1]))
        assert (comes == (cells == cell).any(1)).all()


def test_minhash(docs, empty):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = [(d, shingles(t)) for d, t in docs.select("doc_id", "text").collect()]
    pairs = [(a, b) for a, s in rows for b, t in rows if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    comp = union_find(pairs)
    got = minhash.near_duplicates(docs).collect()
    assert sorted((str(g.doc_id), g.n_shingles, g.component_id) for g in got) == sorted((str(d), len(s), comp.get(d, d)) for d, s in rows)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert minhash.keep_first(empty).count() == 0
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({d for d, _ in rows if d is not None and comp.get(d, d) == d})
    assert minhash.near_duplicates(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers as public

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, length=64, limit=3).collect()
    ids = {}
    for d, t in docs.select("doc_id", "text").distinct().collect():
        ids[d] = tok.encode(t or "", add_special_tokens=False).ids + [0]
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    copies = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    for d, p in pieces.items():
        times = collections.Counter(k for at, n in p for k in range(at, at + n))
        assert set(times) == set(range(len(ids[d]))) and set(times.values()) == {copies[d]}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_warc(spark):
    big = "<p>" + "é" * 60_000
    rows = [(1, "u", "<p>a"), (2, "u\r\nX: y", "<p>a"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "u", "<p>a"), (7, "u", big + "!"), (7, "u", big + "!")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, winner string")
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    got = sorted(warc.round_trip(pages).collect(), key=str)
    assert all(g.intact for g in got) and len(got) == len(rows)
    want = [(i, len((h or "").encode()), warc.digest((h or "").encode()), *(("response", None) if i is None or best[h or ""] == i else ("revisit", best[h or ""]))) for i, _, h in rows]
    assert sorted(map(str, want)) == sorted(str((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to)) for g in got)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_of_lost_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 3}" + "x" * 40_000) for i in range(9)], "page_id long, url string, html string")
    files = warc.write_archives(pages, f"file://{tmp_path}/a", archive=1000)
    again = warc.write_archives(pages, f"file://{tmp_path}/a", archive=1000)
    (tmp_path / "a" / "part-000000-000000-99999.warc.gz").write_bytes(b"broken off")
    assert not {r.path for r in files.collect()} & {r.path for r in again.collect()}
    for f in (files, again):
        got = warc.read_archives(spark, f).collect()
        assert sorted(g.page_id for g in got) == list(range(9)) and all(g.intact for g in got)
        assert sum(g.record_type == "response" for g in got) == 3
    (tmp_path / "a" / "part-000000-000000-99999.warc.gz").unlink()
    assert warc.read_archives(spark, f"file://{tmp_path}/a").count() == 18


def test_chunks_and_broken_segments():
    body = bytes(range(256)) * 100
    assert warc.dechunked(warc.chunked(body, 999)) == body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(warc.chunked(body)[:500])
    parts = [b for _, b in warc.parse(b"".join(warc.response("urn:page:1:0-0", "u", body, warc.digest(body))))]
    assert warc._checked(b"".join(parts), warc.digest(body), sum(map(len, parts))) == (body, True)
    assert not warc._checked(b"".join(parts[::-1]), warc.digest(body), None)[1]


@pytest.mark.parametrize("hot", [run_index.HOT, 100])
def test_run_index(docs, empty, hot):
    n = run_index.LENGTH
    rows = docs.select("doc_id", "text").collect()
    bodies = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i : i + n] for _, b in bodies for i in range(len(b) - n + 1))
    want = []
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    before = run_index.HOT
    try:
        run_index.repeats.__defaults__ = (hot,)
        got = [tuple(r) for r in run_index.measure(docs).collect()]
    finally:
        run_index.repeats.__defaults__ = (before,)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert run_index.measure(empty).count() == 0


def test_strip_keeps_columns(docs):
    out = run_index.strip(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


CLASH = "row string, h long, g long, k long, key string, d long, xh long, spans string, t string, failed string, v string, n_words long, pos long, _d long, _x long, c long, body string, size long, source_size long, B long"


def test_columns_of_any_name_are_kept(spark):
    """Stages that return documents pass on columns that are called like their own."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    passage = prose(60)
    texts_ = [prose(80) + " " + passage for _ in range(4)] + [prose(50) for _ in range(6)]
    rows = [(i, t, "en", f"s{i % 2}", len(t), *("x" if c.endswith("string") else 77 + i for c in CLASH.split(", "))) for i, t in enumerate(texts_)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)
    for f in (quality_rules.keep_good, minhash.keep_first, run_index.strip, mixing.take):
        out = f(d)
        assert out.columns == d.columns
        got = {r.doc_id: [r[n] for n in names] for r in out.collect()}
        assert got and all(v == list(rows[i][5:]) for i, v in got.items()), f
    assert mixing.plan(d).count() == quality_rules.judge(d).count() == run_index.measure(d).count() == minhash.near_duplicates(d).count() == 10


def test_rows_that_share_a_doc_id_keep_their_texts(spark):
    a, b, c = prose(50), prose(50), prose(50)
    near = b.split()
    near[0] = "other"
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, " ".join(near)), (5, None), (5, ""), (None, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, minhash.keep_first(d).collect())) == sorted(map(str, d.where("doc_id is null or doc_id in (1, 5) or doc_id = 3").distinct().collect()))
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(d).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 5), (None, None)}


def test_matching_statistics():
    parts = [b"abracadabra" * 3, b"cadabra", b"xyz", b"bracada"]
    x = run_index.RunIndex(parts)
    text = b"\xff".join(parts) + b"\xff"
    got = x.statistics()
    for i in range(len(text)):
        rem = int(x.rem[i])
        best = max(next((k for k in range(min(rem, int(x.rem[j])) + 1) if k == min(rem, int(x.rem[j])) or text[i + k] != text[j + k])) for j in range(len(text)) if j != i)
        assert min(int(got[i]), rem) == best
    assert len(x.heads) == len(x.symbols) <= len(text)


def test_quality_rules(docs, empty):
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        g = rows[d]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert g.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (g.kept and g.base_failed)
    assert rows[0].kept
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(empty).count() == 0


def test_variety_at_every_length(spark):
    r = random.Random(5)
    draw = lambda n, k: " ".join(f"w{r.randrange(k)}" + ("." if i % 10 == 9 else "") for i in range(n))
    junk, fine = [draw(n, 60) for n in (1900, 2100, 8000, 30_000)], [draw(n, 3000) for n in (1900, 2100, 8000, 30_000)]
    v = quality_rules.RULES.index("variety")
    rows = sorted(quality_rules.judge(frame(spark, ["start", "start", "start", "start", *junk, *fine])).where("doc_id > 3").collect(), key=lambda x: x.doc_id)
    assert [x.v[v] for x in rows] == [-1] * 4 + [0] * 4


def test_rule_weights():
    k = len(quality_rules.RULES)
    vote = lambda *bad: tuple(-1 if j in bad else 0 for j in range(k))
    m = quality_rules.fit([(vote(), 900), (vote(0), 50), (vote(0, 1), 30)])
    assert m["weights"][0] > 2 and all(w >= 0 for w in m["weights"])
    assert quality_rules.fit([])["weights"][0] > 0


def test_pu_quality(spark, docs, empty):
    good = [prose(80) for _ in range(150)]
    bad = [" ".join(w + "***" for w in prose(80).split()) for _ in range(60)]
    d = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in pu_quality.scores(d, pu_quality.train(d, labels)).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(210) if i != 3 and got[i].held_out]
    assert np.mean([got[i].predicted == (i < 150) for i in held]) > 0.9
    none = pu_quality.train(docs, labels.where("false"))
    assert pu_quality.scores(docs, none).count() == docs.count()
    assert pu_quality.scores(empty, none).count() == 0


def test_grams_are_counted_over_all_rows(spark):
    """Presence of hashed words, pairs and byte runs in positives and in the rest, against a plain count."""
    rows = [(i, prose(R.randint(0, 30)) if i % 9 else None) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    good = {i for i in range(0, 60, 3)}
    flag = (pu_quality.F.col("doc_id") % 3 == 0).cast("int")
    odds = pu_quality.learn_odds(d.select("text", flag.alias("good")))
    n = [collections.Counter(), collections.Counter()]
    for i, t in rows:
        n[i in good].update(set(pu_quality.grams((t or "").encode()).tolist()))
    ratio = odds.of(np.arange(3 * pu_quality.BUCKETS))
    for g in range(len(ratio)):
        want = math.log((n[1][g] + 1) / (len(good) * (n[0][g] + n[1][g]) / 60 + 1))
        assert ratio[g] == pytest.approx(want, abs=1e-9)


def test_repeated_passages_of_any_length_and_place():
    at = 13
    assert pu_quality.describe(" ".join(map(str, range(50_000))).encode())[at] == 0
    assert pu_quality.describe(b"one two")[at] == pu_quality.describe(b"")[at] == 0
    once = [str(i) for i in range(50)]
    assert pu_quality.describe(" ".join([*once, "x", *once]).encode())[at] == pytest.approx(47 / 98)
    assert pu_quality.describe(b"a b c d " * 20_000)[at] > 0.99


def test_mixing(docs, empty):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    total, targets = sum(r["size"] for r in rows), {}
    for r in rows:
        targets[r.source_size] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size
    assert sum(targets.values()) == pytest.approx(total)
    for size, target in targets.items():
        assert abs(sum(r.taken for r in rows if r.source_size == size) - target) <= 4 * mixing.LEAST_BLOCK
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, rows))
    assert mixing.take(docs).columns == docs.columns
    assert mixing.plan(empty).count() == mixing.take(empty).count() == 0


def test_mix_is_the_schedule(spark, monkeypatch):
    """Slots in order, each with the documents whose middle word lies in its block of the source's stream."""
    monkeypatch.setattr(mixing, "RUN", 8)
    rows = [(i, prose(R.randint(0, 60)), ["a", "b", None, "d"][min(3, i % 7)]) for i in range(150)] + [(7, "same text here", "a")] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = [(r.doc_id, r.text, r.source) for r in mixing.take(d).collect()]
    size = lambda t: len(t.split())
    key = lambda r: (hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), size(r[1]))
    total = collections.Counter()
    for r in rows:
        total[r[2]] += size(r[1])
    info = mixing.targets(mixing.sized(d)).collect()
    least = min(x.target for x in info if x.target > 0)
    block = max(16, -(-sum(total.values()) // mixing.SLOTS))
    block = max(16, int(least // 64)) if block * 64 > least else block
    n = round(sum(total.values()) / block)
    ends, seen, want = [(x.lo, x.hi, x.source) for x in info], collections.Counter(), collections.defaultdict(list)
    at = {}
    for k in range(n):
        x = (k + 0.5) * mixing.GOLDEN % 1.0
        s = next(s for lo, hi, s in ends if lo <= x < hi)
        at[s, seen[s]] = k
        seen[s] += 1
    for s in total:
        off = 0
        for r in sorted((r for r in rows if r[2] == s), key=key):
            for e in range(3):
                pos = off + size(r[1]) // 2 + e * total[s]
                if size(r[1]) and (s, pos // block) in at:
                    want[at[s, pos // block]].append((pos, r))
            off += size(r[1])
    assert got == [r for k in sorted(want) for _, r in sorted(want[k], key=lambda x: x[0])]


def test_mixing_keeps_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)
    rows = [(i, prose(1000), "a") for i in range(60)] + [(100, prose(30), "b"), (101, prose(120), "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(d).collect()
    for size, target in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if r.source_size == size) - target) <= 4 * mixing.LEAST_BLOCK
    assert {100, 101} <= {r.doc_id for r in mixing.take(d).collect()}


def test_extract(spark):
    page = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy this</div><article><h1>A &amp; B</h1><p>First  text\nhere, long enough to be prose.<p>Second one is here too, as long as the first.</article><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain words"), (5, "u", "<<<p class=\"x> <b"), (1, "u", page)]
    got = extract.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "A & B\nFirst text here, long enough to be prose.\nSecond one is here too, as long as the first."
    assert by[1].n_chars == len(by[1].text) and by[2].text == "" and by[3].n_chars == 0 and by[None].text == "plain words"
    assert len(got) == len(rows)


def test_decoding_is_hierarchical():
    nodes, _, _ = extract.parse("<div><p>a<p>b</div>")
    take = extract.decode(nodes, np.array([1.0, -9.0, 2.0, 2.0]))
    assert take.tolist() == [True, False, False, False]
    assert extract.decode(nodes, np.array([1.0, -3.0, 2.0, 2.0])).all()


def test_decoding_is_the_best_of_all_labellings():
    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(2, 9))
        nodes = [extract.Node("div", int(r.integers(i)) if i else -1, 0, [], 0, 0, 0) for i in range(n)]
        score = np.round(r.normal(size=n), 1)
        ok = [y for y in itertools.product((False, True), repeat=n) if y[0] and all(y[nodes[i].parent] or not y[i] for i in range(1, n))]
        best = max(sum(s if k else -s for s, k in zip(score, y)) for y in ok)
        got = tuple(extract.decode(nodes, score).tolist())
        assert got in ok and sum(s if k else -s for s, k in zip(score, got)) == pytest.approx(best)
    assert extract.decode(extract.parse("<p>a<p>b")[0], np.zeros(3)).tolist() == [True] * 3


def test_extraction_of_unseen_pages():
    m = extract.model()
    right = 0
    pages = extract.pages_to_learn(60, seed=1234)
    for page, labels in pages:
        got = extract.parse(page, m.weights)
        right += len(got[0]) == len(labels) and bool((extract.decode(got[0], m.score(got)) == np.array(labels)).all())
    assert right >= 0.85 * len(pages)


def test_unknown_names_weigh_nothing():
    m = extract.model()
    page = "<body><div class='zzq'><h1>Title of it</h1><p>" + "Plain words of a story, and more of them. " * 12 + "</p><p>" + "Another part of it, long enough. " * 9 + "</p></div><ul class='qqz'><li><a href=/>Home</a><li><a href=/x>News</a><li><a href=/y>More</a></ul></body>"
    assert not {"zzq", "qqz"} & set(m.weights)
    assert extract.main_texts([page], m)[0].startswith("Title of it\nPlain words")


def test_hostile_pages_are_read_in_linear_time():
    m = extract.model()
    pages = ["<a " * 350_000, "<a " * 350_000 + ">", '<a ">" ' * 150_000, "<div>" * 2000 + "</x>" * 250_000, "<b>" * 100_000 + "<hr>" * 50_000, "<!" * 400_000, "<script>" * 100_000, "<a b='" * 100_000]
    for p in pages:
        began = time.process_time()
        extract.main_texts([p], m)
        assert time.process_time() - began < 5


def test_broken_tags():
    text = lambda p: extract.text_of(extract.parse(p)[1], [True] * 99)
    assert text("a < b <c") == "a < b <c"
    assert text("<!-- x") == "" and text("1<script>2") == "1" and text("1<SCRIPT>2</script >3") == "13"
    assert text("<p title='a>b'>c<P>d</q>e") == "c\nde" and text("x<!doctype>y<?z?>") == "xy"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert set(docs.columns) == {c.split()[0] for c in PLAIN.split(", ")}, name
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_minhash_pair_leaves_by_one_bucket():
    """A pair over the threshold leaves by exactly one of the buckets that it shares, also where sketches agree by chance."""
    r = np.random.default_rng(7)
    left_out = 0
    for _ in range(150):
        x = r.integers(0, 1 << 63, 240, np.uint64)
        a, b = np.unique(x[:224]), np.unique(x[16:])  # similarity 0.87
        bands = [minhash._bands(minhash.signature(s)) for s in (a, b)]
        shared = [k for k in range(minhash.BANDS) if bands[0][k] == bands[1][k]]
        t = {"id": [1, 2], "n": [len(a), len(b)], "component": [1, 2], "side": [0, 0], "sketch": [minhash.sketch(a), minhash.sketch(b)]}
        got = [minhash._likely(pa.table(t | {"band": [k, k]})).to_pylist() for k in shared]
        assert [g for g in got if g] == ([[{"a": 1, "b": 2}]] if shared else [])
        left_out += not shared
    assert not left_out
