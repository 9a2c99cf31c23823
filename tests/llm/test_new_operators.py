"""Whitening, anchored repeats and conversation repair against brute force written apart from the operators."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from compare import connect, rows

from skylattice.llm import anchors, queries, secrets, similarity_join, turns, whitening

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening
def check_whitening(vectors, got, k=32):
    """Rows of the operator against exact fractions and a separate eigen-decomposition."""
    ints = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, dims = len(ints), len(ints[0])
    total = [sum(r[d] for r in ints) for d in range(dims)]
    centred = [[n * x - s for x, s in zip(r, total)] for r in ints]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(dims)] for i in range(dims)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    y = defaultdict(dict)
    for r in got:
        y[r.vec_id][r.component] = r
    assert len(got) == n * min(k, dims)
    for (key, _), c in zip(vectors, centred):
        assert {r.deviation for r in y[key].values()} == {sum(x * x for x in c)} and {r.n for r in y[key].values()} == {n}
    kept = [j for j in range(min(k, dims)) if values[j] > 1e-12 * values[0]]
    out = np.array([[y[key][j + 1].whitened for j in kept] for key, _ in vectors], float)
    plain = np.array(centred, float) / n @ basis[:, kept] / np.sqrt(values[kept])
    sign = np.sign((out * plain).sum(0))
    assert np.abs(out - plain * sign).max() < 1e-6
    assert max(r.identity_error for r in got) < 1e-4 and np.abs(out.T @ out / n - np.eye(len(kept))).max() < 1e-6
    for j in range(min(k, dims)):
        assert y[vectors[0][0]][j + 1].explained == pytest.approx(values[j] / np.trace(cov), rel=1e-4, abs=1e-12)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening([(r.vec_id, r.embedding[:12]) for r in table.collect()], whitening.whitened(table.selectExpr("vec_id", "slice(embedding, 1, 12) AS embedding", "label AS n")).collect())
    full = queries.op11_embedding_whitening(spark, SF)
    assert full.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and full.count() == 500 * 32


def test_covariances_are_exact_far_from_zero():
    random.seed(3)
    x = [[random.choice((-1, 1)) * random.randrange(10**9) + 10**14 for _ in range(3)] for _ in range(50)]
    n, sums = 50, [sum(r[d] for r in x) for d in range(3)]
    m = [(2 * s + n) // (2 * n) for s in sums]
    squares = {(i, j): sum(((r[i] - m[i]) + (r[j] - m[j]) if i != j else r[i] - m[i]) ** 2 for r in x) for i in range(3) for j in range(i, 3)}
    cov = whitening.covariances(n, [s - n * c for s, c in zip(sums, m)], squares)
    for i in range(3):
        for j in range(3):
            assert cov[i, j] == float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3))


def test_whitening_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    some = [(i, [float(i % 3), float(i * i % 7), 1e4 * (i % 5)]) for i in range(20)]
    bad = [(100, None), (101, [1.0, nan, 2.0]), (102, [inf, 0.0, 0.0]), (103, []), (104, [1.0, None, 2.0]), (105, [1.0, 2.0]), (106, [1.0] * 4)]
    schema = "vec_id long, embedding array<double>, key string, component int"
    got = whitening.whitened(spark.createDataFrame([(i, v, "k", 1) for i, v in some + bad], schema)).collect()
    check_whitening(some, got)
    # a dimension without variance, repeated and null ids
    flat = [(1, [1.0, 5.0]), (1, [1.0, 5.0]), (None, [2.0, 5.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, "k", 1) for i, v in flat], schema)).collect()
    assert sorted((str(r.vec_id), r.component, r.whitened is None) for r in got) == [("1", 1, False), ("1", 1, False), ("1", 2, True), ("1", 2, True), ("None", 1, False), ("None", 2, True)]
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], "k", 1)], schema)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, 0.0, 0, 0.0)] * 2
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    huge = whitening.whitened(spark.createDataFrame([(1, [1e300, 2.0], "k", 1), (2, [-1e300, 2.5], "k", 1), (3, [0.0, 9.0], "k", 1)], schema)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id != 3} == {None}


# ---------------------------------------------------------------- repeats
def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_removal(texts, length):
    lists = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    out = []
    for w in lists:
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("period", sorted(anchors.COVERS))
def test_covers(period):
    cover = set(anchors.COVERS[period])
    assert all(any((k + d) % period in cover and k in cover for k in range(period)) for d in range(period))


@pytest.mark.parametrize("length", [1, 2, 5, 20, 35, 50])
def test_removal_by_brute_force(spark, length):
    random.seed(length)
    few, passage = [f"w{i}" for i in range(3)], [f"p{i}" for i in range(4 * length + 9)]
    texts = []
    for i in range(60):
        t = [random.choice(few) if i % 7 == 0 else f"{i}x{j}" for j in range(random.randrange(1, 3 * length + 20))]
        for _ in range(random.randrange(3)):
            a = random.randrange(len(passage))
            at = random.randrange(len(t) + 1)
            t[at:at] = passage[a : a + random.randrange(1, 2 * length + 3)]
        texts.append(random.choice([" ", "\n", " \t"]).join(t))
    texts += [" ".join(["same"] * (length + 1)), " ".join(["once"] * length), " ".join(["a", "b"] * (2 * length)), texts[3], texts[3], " ".join(passage).upper(), "", None, " \n"]
    table = spark.createDataFrame([(i % 50, t, "x", 1, True) for i, t in enumerate(texts)], "doc_id long, text string, tkey string, at int, varied boolean").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in anchors.without_repeats(table, length).collect())
    assert got == sorted((i % 50, *r) for i, r in enumerate(plain_removal(texts, length)))


def test_removal_of_hot_blocks(spark):
    """One passage in a third of all texts, and one line of an anchor's length in very many contexts."""
    passage, line = " ".join(f"p{i}" for i in range(60)), " ".join(f"l{i}" for i in range(20))
    texts = [f"{' '.join(f'{i}a{j}' for j in range(i % 29))} {passage if i % 3 == 0 else line} {' '.join(f'{i}b{j}' for j in range(40))}" for i in range(600)]
    got = sorted(tuple(r) for r in anchors.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(i, *r) for i, r in enumerate(plain_removal(texts, 35))] and sum(r[2] for r in got) == 200 * 60


def test_removal_on_odd_rows_and_by_sql(spark, odd):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in anchors.without_repeats(odd).collect())
    assert got == sorted([("1", 11, 0), ("1", 11, 0), ("2", 0, 0), ("None", 3, 0), ("None", 0, 0), ("3", 0, 0), ("4", 0, 0), ("5", 30000, 30000), ("6", 30000, 30000), ("7", 1, 0)])
    empty = anchors.digests(odd.where("doc_id IN (2, 5)")).collect()
    assert {r.kept_sha256 for r in empty if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert anchors.digests(odd.limit(0)).count() == 0
    df = queries.op12_substring_dedup(spark, SF)
    cur = connect("0.001").execute(queries.OP12_SQL)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


# ---------------------------------------------------------------- conversations
def plain_repair(rows_):
    """Least (cost, audit) over all edits by exhaustive search of states, and the repaired rows."""
    rows_ = list(rows_)
    seen, faults = set(), []
    for role, text in rows_:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {}

    def fits(initials):
        return re.fullmatch(r"(s?(ua)+)?", initials) is not None

    def could(initials):
        return any(fits(initials + x) for x in ("", "a", "ua"))

    # states by (rows read, what the grammar remembers of the initials); all audits of least cost are kept
    def state(initials):
        return {"": 0, "s": 1}.get(initials, 2 if initials.endswith("u") else 3)

    todo = [(0, "", 0, "", ())]
    done = None
    import heapq

    while todo:
        cost, audit, read, initials, made = heapq.heappop(todo)
        if done and cost > done[0]:
            break
        if best.setdefault((read, state(initials)), cost) < cost:
            continue
        if read == len(rows_) and fits(initials) and (done is None or (cost, audit) < done[:2]):
            done = (cost, audit, made)
        steps = [(3, "I", 0, r, (r, "")) for r in ("user", "assistant")]
        if read < len(rows_):
            (role, text), fault = rows_[read], faults[read]
            steps.append((4, "D", 1, "", None))
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                steps.append((cut, "K", 1, role or "?", (role, text)))
                steps += [(3 + cut, "R", 1, r, (r, text)) for r in ("user", "assistant")]
        for price, letter, step, role, row in steps:
            after = initials + role[:1]
            if could(after) and len(after) <= 2 * len(rows_) + 2:
                heapq.heappush(todo, (cost + price, audit + letter, read + step, after, made if row is None else (*made, row)))
    return done, faults


def plain_row(conv, sent):
    """The contract's row of one conversation from its undamaged rows."""
    show = lambda v: " " if v is None else str(v)
    left = []
    for turn, role, text in sent:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    (cost, audit, made), faults = plain_repair([r[1:] for r in left])
    known = [t for t, _, _ in left if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
    return (conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def test_repair_of_the_table(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        sent = defaultdict(list)
        for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
            sent[r.conv_id].append((r.turn, r.role, r.text))
        df = queries.op13_conversation_repair(spark, sf)
        assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(tuple(r) for r in df.collect()) == sorted(plain_row(c, rows) for c, rows in sent.items())


def test_repair_of_all_short_code_sequences():
    codes = [0, 4, 8, 11, 12, 15, 9, 14]
    for n in range(4):
        for k in range(len(codes) ** n):
            c = bytes(codes[k // len(codes) ** i % len(codes)] for i in range(n))
            assert turns.cheapest(c) == plain_codes(c)


def test_repair_of_long_ties():
    random.seed(13)
    for _ in range(300):
        c = bytes(random.choice([0, 4, 8, 8, 8, 11, 12, 12, 15]) for _ in range(random.randrange(4, 9)))
        assert turns.cheapest(c) == plain_codes(c)


def plain_codes(codes):
    text = {0: "fine.", 1: "", 3: "cut"}
    rows_ = []
    for i, c in enumerate(codes):
        role = ("other", "system", "user", "assistant")[c // 4]
        # a duplicate needs an earlier equal row, which a code alone lacks; both must be deleted, as blank rows
        rows_.append((role, text[1] if c % 4 == 2 else text[c % 4] and f"{i} {text[c % 4]}"))
    return plain_repair(rows_)[0][:2]


def test_repair_on_odd_rows(spark):
    sent = [(1, None, "user", "a."), (1, None, None, "b."), (1, 2, "assistant", None), (1, 3, "", "c?"), (None, 1, "user", "hi."), (None, 2, "assistant", "ho!"), (None, None, "system", "s."),
            (2, None, None, None), (3, 1, "user", "x" * 200_000 + "."), (3, 1, "user", "x" * 200_000 + "."), (4, 9, "assistant", " \n"), (5, -3, "Ünder", " "), (5, 7, "user", "a.\n\n")]
    table = spark.createDataFrame([(*r, 1, "z") for r in sent], "conv_id long, turn long, role string, text string, part int, h1 string").repartition(4)
    by = defaultdict(list)
    for c, *r in sent:
        by[c].append(tuple(r))
    got = {r.conv_id: tuple(r) for r in turns.damage_and_repair(table).collect()}
    assert set(got) == set(by)
    for c in by:
        if c != 1:  # two rows without a turn have no order of their own
            assert got[c] == plain_row(c, by[c])
    assert turns.damage_and_repair(table.limit(0)).count() == 0
    gone = next(i for i in range(100) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (next(t for t in range(10**4) if zlib.crc32(f"{i}:{t}".encode()) % 20 == 0),)))
    turn = next(t for t in range(10**4) if zlib.crc32(f"{gone}:{t}".encode()) % 20 == 0)
    lost = turns.damage_and_repair(spark.createDataFrame([(gone, turn, "user", "x")], "conv_id long, turn int, role string, text string")).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_of_one_long_conversation(spark):
    """A conversation over many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sent = [(7, t, "user" if t % 2 else "assistant", f"text {t % 50} of {t}.") for t in range(400)] + [(c, t, "user", "hello") for c in range(20, 40) for t in range(3)]
        got = {r.conv_id: tuple(r) for r in turns.damage_and_repair(spark.createDataFrame(sent, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    short = {c: [r[1:] for r in sent if r[0] == c] for c in range(20, 40)}
    assert all(got[c] == plain_row(c, short[c]) for c in short)
    audit, n = got[7][7], sum(2 if (k := zlib.crc32(f"7:{t}".encode()) % 20) == 3 else k != 0 for t in range(400))
    assert sum(e != "I" for e in audit) == n and got[7][6] > 0


# ---------------------------------------------------------------- earlier operators
def test_long_base64_runs_take_time_in_proportion():
    """Megabytes without a line break, as an inline image has them, with a secret at the end that is found."""
    took = []
    hidden = base64.b64encode(b"password = correcthorsebattery").decode()
    for size in (500_000, 2_000_000):
        body = base64.b64encode(random.Random(1).randbytes(size)).decode()
        text = f"data:image/png;base64,{body} and {hidden}"
        start = time.perf_counter()
        spans = secrets.all_spans(text)
        took.append(time.perf_counter() - start)
        assert any(kind == "assign" and a >= len(text) - len(hidden) for kind, a, _ in spans)
    assert took[1] < 12 * took[0] + 1 and took[1] < 60


def test_one_of_each_with_clashing_names(spark):
    rows_ = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (None, ""), (4, "other words stand here now and then")]
    table = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5, 6) for d, t in rows_], "doc_id long, text string, single int, wkey int, wid int, __class int, __KEEP int, tkey int")
    kept = similarity_join.one_of_each(table)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


def test_every_trusted_text_counts_however_many_there_are(spark):
    from skylattice.llm import quality

    docs = spark.createDataFrame([(i, f"word{i} and more words of text {i}") for i in range(6)] + [(None, "no id here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 4), int(i == 5)) for i in range(6)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_ids(labels)
    assert sorted(r[0] for r in trusted.collect()) == [0, 1, 2, 3]
    whole, raw = quality.gram_counts(docs, trusted)
    target, again = quality.gram_counts(docs, trusted, few=1)
    kept = quality.gram_counts(docs.where("doc_id < 4"), trusted)[1]
    assert (whole == target).all() and (raw == again).all() and (whole == kept).all()
