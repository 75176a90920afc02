import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from cadentia.llm import kneser

DOCS = "doc_id long, text string, score string, n_tokens string"


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [*(w for w in lowered.split(" ") if w), "</s>"]


class Plain:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order, seqs = order, [["<s>", *tokens(t)] for t in texts]
        raw = {k: Counter(tuple(s[i - k + 1 : i + 1]) for s in seqs for i in range(1, len(s)) if i >= k - 1) for k in range(1, order + 1)}
        self.raw, self.counts = {w[0]: c for w, c in raw[1].items()}, {order: raw[order]}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
            for g, c in raw[k].items():
                if g[0] == "<s>":
                    self.counts[k][g] = c
        self.d, self.total, self.followers = {}, {}, {}
        for k, counts in self.counts.items():
            t = [sum(c == n for c in counts.values()) for n in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1]) if min(t) else 0
            self.d[k] = [min(max(n - n * y * t[n] / t[n - 1], 0), n) for n in (1, 2, 3)] if min(t) else [0.5, 1.0, 1.5]
            self.total[k], self.followers[k] = Counter(), defaultdict(lambda: [0, 0, 0])
            for g, c in counts.items():
                self.total[k][g[:-1]] += c
                self.followers[k][g[:-1]][min(c, 3) - 1] += 1

    def p(self, context, word):
        p = 1 / (len(self.raw) + 1)
        for k in range(1, self.order + 1):
            if len(context) < k - 1:
                break
            h = tuple(context[len(context) - k + 1 :])
            total, c = self.total[k][h], self.counts[k][(*h, word)]
            if total:
                p = ((c - self.d[k][min(c, 3) - 1] if c else 0) + sum(d * n for d, n in zip(self.d[k], self.followers[k][h])) * p) / total
        return p

    def score(self, text):
        seq = ["<s>", *tokens(text)]
        n = sum(self.raw.values())
        base = sum(math.log10((self.raw.get(w, 0) + 0.5) / (n + 0.5 * (len(self.raw) + 1))) for w in seq[1:])
        return len(seq) - 1, sum(w in self.raw for w in seq[1:]), base, sum(math.log10(self.p(seq[:i], seq[i])) for i in range(1, len(seq)))


def some_docs(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('aBcé')}{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (None, "new words, here"), (n + 1, "A1 a1"), (n + 2, " ".join(rng.choices(vocabulary, weights, k=900))), (n + 3, "x" * 5000)]


@pytest.mark.parametrize(("order", "shard_bytes", "part_bytes"), [(2, 10**9, 10**9), (2, 900, 700), (3, 2_000, 300), (4, 10**9, 1_000)])
def test_model_against_dictionaries(spark, monkeypatch, order, shard_bytes, part_bytes):
    monkeypatch.setattr(kneser, "PART_BYTES", part_bytes)
    monkeypatch.setattr(kneser, "COUNT_BYTES", 8 * part_bytes)
    docs = some_docs(150)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS).repartition(3)
    model = kneser.train(df.filter(~kneser.held_out()), order, shard_bytes)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    plain = Plain([t for i, t in docs if not held(i)], order)
    assert model.totals[1][0] == len(plain.raw) and model.totals[1][2] == sum(plain.raw.values())
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser.score(df, model).collect())
    want = sorted((i is not None, i or 0, *plain.score(t)) for i, t in docs)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)
    for context in (["<s>"], ["<s>", "a0"], ["never", "seen"], ["a1", "c2", "B3"]):
        assert sum(plain.p(context, w) for w in [*plain.raw, "unknown"]) == pytest.approx(1)


def test_model_of_nothing(spark):
    df = spark.createDataFrame([(1, "one two", "", "")], DOCS)
    model = kneser.train(df.limit(0))
    r = kneser.score(df, model).first()
    assert (r.n_tokens, r.n_known, r.base_score, r.score) == (3, 0, 0, 0)
    assert kneser.score(df.limit(0), model).count() == 0


def test_files_are_fetched_where_they_cannot_be_mapped(tmp_path):
    import numpy as np
    from pyarrow.fs import FileSystem, SubTreeFileSystem

    class Far(kneser.Store):
        def _at(self):  # no LocalFileSystem, as far as a task can see
            fs, folder = FileSystem.from_uri(self.uri)
            return SubTreeFileSystem("/", fs), folder

    for store in (kneser.Store(f"file://{tmp_path}/a"), Far(f"file://{tmp_path}/b")):
        store.write("gram-1-0", np.array([3, 9, 2**63], np.uint64), [np.array([1, 2, 70_000], np.uint64)])
        assert store.find("gram-1-0", np.array([1, 3, 2**63, 2**64 - 1], np.uint64), 1).tolist() == [[0, 1, 70_000, 0]]
        assert store.find("gram-1-9", np.array([1], np.uint64), 2).tolist() == [[0], [0]]


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    """On text with an order of words, the model beats unigrams on texts it has not seen."""
    rng = random.Random(3)
    follow = {k: [rng.randrange(50) for _ in range(3)] for k in range(50)}
    docs = []
    for i in range(300):
        k, text = rng.randrange(50), []
        for _ in range(60):
            k = rng.choice(follow[k])
            text.append(f"w{k}")
        docs.append((i, " ".join(text), "", ""))
    df = spark.createDataFrame(docs, DOCS)
    out = kneser.score(df.filter(kneser.held_out()), kneser.train(df.filter(~kneser.held_out()))).collect()
    assert len(out) > 30 and all(r.score > 0.6 * r.base_score for r in out)
