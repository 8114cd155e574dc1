"""Mixing, near duplicates, line runs and language identification against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platterlake.llm import language_id, line_dedup, mixing, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_ and left > 1e-9:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        left = 0.0
        for i, x in share.items():
            target[i] += x
        for i in list(open_):
            if target[i] >= 3 * sizes[i]:
                left += target[i] - 3 * sizes[i]
                target[i] = 3.0 * sizes[i]
                open_.remove(i)
    return target


def mix_rows(make_docs, spark, rows):
    docs = make_docs(rows).withColumn("sid", F.lit("clash")).withColumn("size", F.lit(-1)).withColumn("row", F.lit(0))
    _, slots, pieces = mixing.mix(docs)
    got = pieces.groupBy("row", "size", "source", "source_size", "target", "sid", "at").agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken"))
    return got.collect(), slots


def test_mix_meets_targets(make_docs, spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 400), "en", rng.choice(["a"] * 12 + ["b", "c", "d", None, "é"])) for i in range(400)]
    rows += [rows[5], rows[5], (None, "null id", "en", "a"), (900, None, "en", "only"), (901, "one", "en", "z")]
    got, slots = mix_rows(make_docs, spark, rows)
    assert len(got) == len(rows)
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, filled([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(WORD.findall(r.row.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=8), s
    again, _ = mix_rows(make_docs, spark, rows)
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    # A stretch of the schedule has every source near its share, and ranks have no gaps.
    seen = slots.orderBy("slot").collect()
    half = Counter(r.sid for r in seen if r.slot < seen[-1].slot // 2)
    for sid, n in Counter(r.sid for r in seen).items():
        assert abs(half[sid] - n / 2) <= 6
        assert sorted(r.rank for r in seen if r.sid == sid) == list(range(n))


def slow_taken(lines, weights=(5, 2, 1)):
    """Words that the schedule takes of each document, from each source's (h, size) in line order."""
    sizes = [sum(n for _, n in line) for line in lines]
    goals = filled(sizes, [weights[i % 3] for i in range(len(lines))])
    blocks = [-(-size // max(1, min(2048, int(goal // 1024)))) for size, goal in zip(sizes, goals, strict=True)]
    shares = [goal * n / size if size else 0.0 for goal, n, size in zip(goals, blocks, sizes, strict=True)]
    ends = np.cumsum(shares) / max(sum(shares), 1e-300)
    met, uses = [0] * len(lines), [[0] * n for n in blocks]
    for i in range(round(sum(shares))):
        point = float(i * mixing.PHI % 1)
        sid = min(int(np.searchsorted(ends, point, "right")), len(lines) - 1)
        block, turn = met[sid] % blocks[sid], met[sid] // blocks[sid]
        met[sid] += 1
        uses[sid][block] += turn < 3
    out = []
    for line, size, n, used in zip(lines, sizes, blocks, uses, strict=True):
        of = [b for b in range(n) for _ in range(size // n + (b < size % n))]
        at = 0
        for h, k in line:
            out.append((h, k, sum(used[b] for b in of[at : at + k])))
            at += k
    return sorted(out)


def test_taken_words_follow_the_schedule(make_docs, spark):
    rng = random.Random(9)
    size = lambda i: 30_000 if i == 7 else rng.randrange(0, 300)  # noqa: E731  one text spans many blocks
    docs = make_docs([(i, f"{i} " * size(i), "en", rng.choice(["a", "a", "b", "c", None])) for i in range(300)])
    line = defaultdict(list)
    for r in mixing.sized(docs, "text", "source", 1, ("doc_id",)).collect():
        line[r.source].append((r.h, r.size))
    want = slow_taken([sorted(line[s]) for s in ("a", "b", "c", None)])
    pieces = mixing.mix(docs, keep=("doc_id",))[2]
    got = pieces.groupBy("h", "size").agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken")).collect()
    assert sorted((r.h, r.size, r.taken) for r in got) == want


def test_mix_of_nothing(make_docs, spark):
    assert mix_rows(make_docs, spark, [])[0] == []
    got, _ = mix_rows(make_docs, spark, [(1, None, "en", None), (2, " ", "en", "s")])
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_mixed_documents_are_whole_and_repeat(make_docs):
    docs = make_docs([(i, "w " * 50, "en", "big" if i % 10 else "small") for i in range(300)])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert max(n.values()) <= 3
    small = [n[i] for i in range(0, 300, 10)]
    assert 2.5 <= np.mean(small) <= 3  # the small source's target stops at three times its size


def test_golden_points_are_even(spark):
    u = np.array([r.u for r in spark.range(5000).select(mixing.golden(F.col("id") + (1 << 35)).alias("u")).collect()])
    assert np.abs(np.sort(u) - (np.arange(5000) + 0.5) / 5000).max() < 5 / 5000


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def slow_components(rows):
    sets = [shingles(r[1]) for r in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c) and name[i] != name[j]:
                a, b = name[i], name[j]
                name = [b if x == a else x for x in name]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[name[i]].append(r[0])
    return [(r[0], len(sets[i]), min((x for x in groups[name[i]] if x is not None), default=None)) for i, r in enumerate(rows)]


def near_texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(6, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 8)):
            now = list(base) if rng.random() < 0.5 else out[-1].split()
            for _ in range(rng.randrange(0, 4)):
                now[rng.randrange(len(now))] = word()
            out.append(" ".join(now))
    passage = " ".join(word() for _ in range(40))
    out += [f"{passage} {word()} {word()} {word()} {' '.join(word() for _ in range(rng.randrange(4, 30)))}" for _ in range(25)]
    return out + out[:6] + [out[0].upper()]


def test_keep_one_keeps_one_text_without_or_with_shared_ids(make_docs):
    text = lambda w, end: " ".join(f"{w}{i}" for i in range(60)) + end
    rows = [(None, text("a", e), "en", "s") for e in ("", " x", " y")]
    rows += [(5, text("b", e), "en", "s") for e in ("", " x", " y")] + [(None, text("b", " z"), "en", "s")]
    rows += [(5, text("c", ""), "en", "s"), (None, text("d", ""), "en", "s"), (None, "", "en", "s"), (6, None, "en", "s")]
    kept = [(r.doc_id, (r.text or "")[:1]) for r in near_dedup.keep_one(make_docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, "a"), (5, "b"), (5, "c"), (None, "d"), (None, ""), (6, "")], key=repr)


def test_components_go_on_from_labels(spark):
    rng = random.Random(3)
    frame = lambda e: spark.createDataFrame(e, "c int, d int")
    first, more = ([(rng.randrange(200), rng.randrange(200)) for _ in range(n)] for n in (90, 40))
    first, more = [e for e in first if e[0] != e[1]], [e for e in more if e[0] != e[1]]
    got = {r.c: r.root for r in near_dedup.extended(near_dedup.components(frame(first)), frame(more)).collect()}
    want = {r.c: r.root for r in near_dedup.components(frame(first + more)).collect()}
    assert got.keys() == want.keys()
    assert len(set(got.values())) == len(set(want.values())) == len({(got[c], want[c]) for c in got})


def test_near_duplicates(make_docs, odd_texts, spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = [(i, t, "en", "s") for i, t in enumerate([*odd_texts, *near_texts()])]
    random.Random(1).shuffle(rows)
    rows += [(None, "a null id with its own text here"), (None, rows[0][1]), rows[1], (rows[2][0], "same id but another text entirely so")]
    rows = [r if len(r) == 4 else (*r, "en", "s") for r in rows]
    docs = make_docs(rows).withColumn("c", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3))
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(slow_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(make_docs([])).count() == 0


def test_prefixes_meet_every_pair_at_the_level(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(11)
    sets, roots = [], []
    for family in range(12):
        base = rng.sample(range(3000), rng.randrange(1, 60))
        for _ in range(rng.randrange(1, 16)):
            kept = [x for x in base if rng.random() < 0.93]
            sets.append(set(kept + rng.sample(range(3000), rng.randrange(0, 8))) or {family})
            roots.append(rng.choice([family, family, len(roots) + 100]))
    sets += [set(range(9)), set(range(10, 17)), {5}, {5}, set(range(9)) | {11}]
    roots += [500, 501, 502, 503, 504]
    classes = spark.createDataFrame([(i, r, len(s)) for i, (s, r) in enumerate(zip(sets, roots, strict=True))], "c long, root long, n long")
    full = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "c long, shingles array<bigint>")
    got = {(r.c, r.d) for r in near_dedup.across(near_dedup.prefixes(classes, full)).collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if roots[i] != roots[j]]
    want = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(want) > 30 and want <= got <= set(pairs)


def test_texts_of_one_template_do_not_meet(spark):
    # Similarity 0.5, 0.6 and 0.7 within a family: no shingle of the template is early enough in the smaller set.
    rng, sets = random.Random(5), []
    for family, shared in enumerate((67, 75, 82)):
        template = [family * 1000 + i for i in range(shared)]
        sets += [template + rng.sample(range(10_000, 10**9), 100 - shared) for _ in range(60)]
    classes = spark.createDataFrame([(i, i, len(s)) for i, s in enumerate(sets)], "c long, root long, n long")
    full = spark.createDataFrame(list(enumerate(sets)), "c long, shingles array<bigint>")
    prefix = near_dedup.prefixes(classes, full)
    assert near_dedup.across(prefix).count() == 0
    short = prefix.where("7 * (n - at) >= 6 * n").groupBy("t").count().agg(F.max("count")).first()[0]
    assert short is None or short <= 2


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    for j in (0.75, 0.9):
        error, flips = [], []
        for _ in range(60):
            both = rng.integers(0, 1 << 62, int(1000 * j)).astype(np.uint64)
            one, two = (np.concatenate([both, rng.integers(0, 1 << 62, int(1000 * (1 - j) / 2)).astype(np.uint64)]) for _ in range(2))
            a, b = near_dedup.minhash(one), near_dedup.minhash(two)
            flips.append(int(np.bitwise_count(near_dedup.odd_sketch(a) ^ near_dedup.odd_sketch(b)).sum()))
            error.append(near_dedup.similarity(flips[-1]) - j)
            assert set(near_dedup.band_values(a)) & set(near_dedup.band_values(b))
            apart = len(one) + len(two) - 2 * len(both)
            assert np.bitwise_count(near_dedup.set_sketch(one) ^ near_dedup.set_sketch(two)).sum() <= apart <= (len(one) + len(two)) / 7
        assert abs(np.mean(error)) < 0.03 and max(flips) <= near_dedup.FLIPS


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    key = list(range(300))
    rng.shuffle(key)
    pairs = [(key[i], key[i + 1]) for i in range(299) if i % 50] + [(key[0], key[60])]
    edges = spark.createDataFrame([((a, a), (b, b)) for a, b in pairs], "c struct<a:bigint,b:bigint>, d struct<a:bigint,b:bigint>")
    got = {r.c.a: r.root.a for r in near_dedup.components(edges).collect()}
    name = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    assert got == name


def slow_lines(rows, depth):
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    lines = {i: [(k, x) for k, x in enumerate((rows[i][1] or "").split("\n")) if WORD.search(x)] for i in order}
    seen, out = set(), {}
    for i in order:
        gone = set()
        own = [x for _, x in lines[i]]
        for p in range(len(own)):
            if tuple(own[p : p + depth]) in seen and len(own[p : p + depth]) == depth:
                gone |= set(range(p, p + depth))
            if (own[p],) in seen and len(WORD.findall(own[p])) >= 50:
                gone.add(p)
            seen.add((own[p],))
            seen.add(tuple(own[p : p + depth]))
        # A run may start inside the same document, so runs are entered as they begin.
        drop = {lines[i][p][0] for p in gone}
        kept = "\n".join(x for k, x in enumerate((rows[i][1] or "").split("\n")) if k not in drop)
        out[rows[i][0]] = (len(own), len(gone), sum(p - 1 not in gone for p in gone), kept)
    return out


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_line_runs(make_docs, odd_texts, depth):
    rng = random.Random(depth)
    pool = ["a b", "c", "d e f", "longer line of words", "w " * 60, "", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(40)] + odd_texts
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = make_docs(rows).withColumn("p", F.lit(1)).withColumn("key", F.lit(2)).withColumn("i", F.lit(2))
    got = line_dedup.dedup_lines(docs, min_lines=depth).collect()
    want = slow_lines(rows, depth)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_deleted, r.n_runs, r.kept_text or "") == want[r.row.doc_id], r.row.text
        assert (r.kept_text is None) == (r.row.text is None)


def test_line_runs_of_equal_rows_and_null_ids(make_docs):
    both = [(7, "x y\nz", "en", "s")] * 2 + [(None, "x y\nz", "en", "s"), (7, "x y\nz\nmore", "en", "s")]
    got = sorted((str(r.row.doc_id), r.kept_text) for r in line_dedup.dedup_lines(make_docs(both)).collect())
    assert got == [("7", ""), ("7", ""), ("7", "more"), ("None", "x y\nz")]
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def test_suffix_ranks_follow_the_order_of_suffixes(make_docs):
    docs = make_docs(["a\nb\nc\na\nb", "a\nb\nd", "b\nc"]).select(F.col("doc_id").alias("id"), "text")
    lines = line_dedup.line_table(docs)
    order = {(r.id, r.p): (r.a, r.b) for r in lines.collect()}
    _, deep = line_dedup.suffix_ranks(lines, 2)
    rows = sorted(deep.collect(), key=lambda r: r["rank"])
    keys = [(order[r.id, r.p], order[r.id, r.p + 1]) for r in rows]
    assert keys == sorted(keys) and len({r["rank"] for r in rows}) == len(set(keys)) == 2 and len(rows) == 5


def slow_runs(seqs, least):
    """(length, copies, earliest) of every run with copies that neither all follow nor all precede one line; ends differ from all."""
    out = []
    for d in range(least, max(map(len, seqs)) + 1):
        places = defaultdict(list)
        for i, s in enumerate(seqs):
            for p in range(len(s) - d + 1):
                places[tuple(s[p : p + d])].append((i, p))
        for at in places.values():
            after = {seqs[i][p + d] if p + d < len(seqs[i]) else (i, p) for i, p in at}
            before = {seqs[i][p - 1] if p else (i, p) for i, p in at}
            if len(at) > 1 and len(after) > 1 and len(before) > 1:
                out.append((d, len(at), *min(at)))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3])
def test_maximal_runs(make_docs, least):
    rng = random.Random(least)
    long = [f"line {i}" for i in range(140)]
    seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(12)] + [["x"] * 9, ["x"] * 5]
    seqs += [long[:140], ["z", *long[3:137]], [*long[60:75], "q"], ["hot", "line"], ["hot", "line", "a"], *([["hot", "line"]] * 30)]
    rows = [(i, "\n".join(s), "en", "s") for i, s in enumerate(seqs)]
    got = line_dedup.repeated_runs(make_docs(rows), min_lines=least).collect()
    want = slow_runs(seqs, least)
    assert sorted((r.length, r.copies, r.id, r.p) for r in got) == want
    assert max(w[0] for w in want) == 134
    # The longest run that a text has a copy of, and rows that are equal in id and text count once.
    deepest = {r.row.doc_id: r.longest_run for r in line_dedup.dedup_lines(make_docs(rows + rows[-1:]), min_lines=least).collect()}
    for i, s in enumerate(seqs):
        grams = lambda d, k: {tuple(seqs[k][p : p + d]) for p in range(len(seqs[k]) - d + 1)}
        twice = lambda d: any(g in grams(d, k) for k in range(len(seqs)) if k != i for g in grams(d, i)) or len(grams(d, i)) < len(s) - d + 1
        assert deepest[i] == max((d for d in range(least, len(s) + 1) if twice(d)), default=0)
    assert line_dedup.repeated_runs(make_docs([]), min_lines=least).count() == 0


SAYS = {"en": "the and of to in is that it was for on with as this", "de": "der die und in den von zu das mit sich des auf für ist", "fr": "le la de et les des en un une est que pour dans qui"}


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SAYS))
        stems = {"en": "thingsh", "de": "schungk", "fr": "eauxtré"}[lang]
        words = [rng.choice(SAYS[lang].split()) if rng.random() < 0.4 else "".join(rng.choice(stems) for _ in range(6)) for _ in range(40)]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None, "s"))
    return rows


def test_language_is_learned_and_kept_apart(make_docs, spoken, odd_texts):
    docs = make_docs([*spoken, *((1000 + i, t, None, "s") for i, t in enumerate(odd_texts)), (None, "the and of", "en", "s")]).withColumn("score", F.lit("clash"))
    split = docs.withColumn("held_out", language_id.held_out())
    model = language_id.learn(split.where("not held_out"))
    got = language_id.identify(split, model, ("doc_id", "lang", "held_out")).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 40 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    for r in got:
        text = dict(enumerate(odd_texts)).get((r.doc_id or 0) - 1000, "letters")
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    assert language_id.identify(make_docs([]), model).count() == 0
    none = language_id.learn(make_docs([(1, "the", None, "s")]))
    assert [r.lang_pred for r in language_id.identify(make_docs(["the"]), none).collect()] == ["und"]


def slow_language(labelled, text):
    """Language and confidence by the definition, word by word; every entry fits the model."""
    langs = sorted({x for _, x in labelled})
    cut = lambda t: re.findall("[a-z\x80-\U0010ffff]+", t.lower())
    counts = {k: defaultdict(lambda: [0] * len(langs)) for k in range(6)}
    for t, lang in labelled:
        for w in cut(t):
            counts[0][w][langs.index(lang)] += 1
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    counts[k][f" {w} "[i : i + k]][langs.index(lang)] += 1
    whole = {k: np.sum(list(c.values()), 0) + 0.5 * len(c) for k, c in counts.items()}

    def logs(k, x):
        rate = np.log((np.array(counts[k][x]) + 0.5) / whole[k])
        return rate - rate.mean()

    def of_word(w):
        if w in counts[0] and sum(counts[0][w]) >= 2:
            return logs(0, w)
        b = f" {w} "
        found, open_ = [], set(range(len(b) - 4))
        for k in range(5, 0, -1):
            open_ |= {0} if len(b) == k else set()
            hit = {i for i in open_ if b[i : i + k] in counts[k]}
            found += [logs(k, b[i : i + k]) for i in sorted(hit)]
            open_ = {j for i in open_ - hit for j in (i, i + 1)}
        return np.mean(found, 0) if found else np.zeros(len(langs))

    if not any(c.isalpha() for c in text):
        return "und", 0.0
    scores = [of_word(w) for w in cut(text)]
    best = int(np.argmax(np.sum(scores, 0)))
    gap = sum(s.max() - s.min() for s in scores)
    return langs[best], float(sum(s[best] - s.min() for s in scores) / max(gap, 1e-9))


def test_predictions_equal_the_definition(spoken, odd_texts):
    labelled = [(t, lang) for _, t, lang, _ in spoken[:120] if lang]
    model = language_id.fit([t for t, _ in labelled], [x for _, x in labelled])
    texts = [t for _, t, *_ in spoken[120:]] + [t for t in odd_texts if t is not None and len(t) < 1000] + ["a", "ab", "the", "schq éau", "ß", "über quark"]
    got = zip(*language_id.predict(model, pa.array(texts, pa.large_string())), strict=True)
    for text, (lang, score) in zip(texts, got, strict=True):
        want = slow_language(labelled, text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4), text


def test_unseen_words_back_off_to_shorter_ngrams():
    model = language_id.fit(["abcdef abcdef abcdef", "uvwxyz uvwxyz uvwxyz"], ["one", "two"])
    for text, want in (("abcdef", "one"), ("abcdeq", "one"), ("qqqabq", "one"), ("qyz", "two"), ("qqz", "two")):
        assert language_id.predict(model, pa.array([text], pa.large_string()))[0] == [want], text
    lang, score = language_id.predict(model, pa.array(["щщщ", "", "12"], pa.large_string()))
    assert lang[1:] == ["und", "und"] and score[1] == 0
