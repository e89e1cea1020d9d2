"""The models: kernel values, held-out accuracy, probabilities that sum to 1, transducer against the library."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm_score, string_kernel, textvec, token_counts, toxicity
from tidemark.llm.attention import Model

SF = "/root/testdata/sf0.01"


def slow_kernel(s, t, p=3, lam=0.6):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += lam ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_is_the_sum_over_common_subsequences():
    words = [b"idiot", b"id-iot", b"iiddt", b"stone", b"ton"]
    x = toxicity.matrix(words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            z = np.where(x[j : j + 1] == 0, 1, x[j : j + 1]).astype(np.uint8)
            assert abs(string_kernel.kernel(x[i : i + 1], z)[0] - slow_kernel(s, t)) < 1e-4


@pytest.mark.skipif(not os.path.isdir(SF.replace("0.01", "0.1")), reason="no test tables here")
def test_toxicity_held_out(spark):
    """Balanced, as a predictor of one label has 0.5."""
    sf = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    caught = [r.predicted for r in rows if r.toxic]
    clean = [1 - r.predicted for r in rows if not r.toxic]
    assert len(caught) > 50 and sum(caught) >= 0.75 * len(caught) and sum(clean) >= 0.95 * len(clean)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_toxicity_of_odd_texts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "\n\t "), (10**9 + 3, "the calm river " * 20_000), (10**9 + 4, "the calm river"), (10**9 + 4, "the calm river"), (None, "the calm river"), (10**9 + 5, "x" * 100_000)]
    got = toxicity.score(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), labels).where("doc_id is null or doc_id >= 1000000000").collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (10**9 + 4, None)}) == 1  # the same text, the same score
    assert toxicity.score(docs.where("false"), labels).count() == 0


def test_model_is_a_distribution_and_learns():
    ids = np.array(([1, 2, 3, -1] * 300) + [4, 5, -1] * 50)
    m = Model(ids, 8, classes=6, width=8, context=8, stride=4)
    losses = m.fit(ids, steps=150, batch=16)
    assert losses[-1] < 0.5 * losses[0]
    one = [m.score(np.array([i]), np.array([1]))[0] for i in range(9)]  # all first tokens, the end among them
    assert abs(sum(np.exp(one)) - 1) < 1e-3
    long = np.array([1, 2, 3] * 9 + [m.end])
    both = m.score(np.concatenate([long, long[:5]]), np.array([len(long), 5]))
    assert abs(both[0] - m.score(long, np.array([len(long)]))[0]) < 1e-3


def test_every_id_is_an_input_and_a_target_of_its_own():
    rng = np.random.default_rng(0)
    after = rng.permutation(40)
    first = rng.integers(0, 40, 4000)
    ids = np.stack([first, after[first], np.full(4000, -1)], 1).ravel()  # all ids are as frequent, the second follows from the first
    m = Model(ids, 40, classes=6, width=16, context=8, stride=4)
    m.fit(ids, steps=600, batch=64)
    pairs = np.stack([np.arange(40), after, np.full(40, m.end)], 1).ravel()
    wrong = np.stack([np.arange(40), np.roll(after, 1), np.full(40, m.end)], 1).ravel()
    gain = m.score(pairs, np.full(40, 3)) - m.score(wrong, np.full(40, 3))
    assert (gain > 1).mean() > 0.9


def test_language_model_learns_from_all_texts_whatever_their_number_and_length(spark):
    pytest.importorskip("public_tokenizers")
    odd = " ".join(["zyzzyva quokka"] * 6000)  # over 50 KB
    docs = spark.createDataFrame([(i, "stone river " * 4) for i in range(4000)] + [(5000, odd)], "doc_id long, text string")
    train = docs.where((lm_score.remainder() != lm_score.HELD) | (docs.doc_id == 5000))
    assert lm_score.training_sample(train, 4_000_000).count() == train.count() > 3000
    big = lm_score.training_sample(train, 10**12, share=0.5)
    assert 0.4 < big.count() / train.count() < 0.6
    count = np.zeros(50_258, np.int64)
    ids, _ = lm_score.subwords(["zyzzyva", "quokka"], None)
    got = {}
    for r in lm_score._count(iter(train.select("text").toArrow().to_batches()), None):
        d = r.to_pydict()
        got |= {h: c for k, h, c in zip(d["kind"], d["h"], d["c"]) if k == 1}
    assert all(got[i] >= 6000 for i in ids.tolist())
    count[list(got)] = list(got.values())
    count[-1] = train.count()
    size = lambda x: np.array([len(x) + 1])
    row = np.concatenate([np.tile(ids, 8), [50_257]])
    flat = lm_score.fit_model(train.select("text"), count, None, rounds=0).score(row, size(row[:-1]))[0]
    assert lm_score.fit_model(train.select("text"), count, None, rounds=4).score(row, size(row[:-1]))[0] > flat + 5


def test_language_model_passes_over_every_training_text_of_a_large_corpus(spark):
    """10^12 bytes, as far as it is told: no share of the texts stands for all of them, and the rounds leave none out."""
    train = spark.createDataFrame([(i, f"stone river {i}") for i in range(400)], "doc_id long, text string").repartition(3)
    sample = lm_score.training_sample(train, 10**12)
    assert sample.count() == 400
    for passes in (1, 2, 4):
        rounds = [[r.text for r in d.collect()] for d in lm_score.texts_of_rounds(sample, 4, passes)]
        every = sorted(t for r in rounds for t in r)
        assert every == sorted(f"stone river {i}" for i in range(400) for _ in range(passes)) and min(map(len, rounds)) > 50 * passes


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_model_beats_the_unigram_base_on_held_out_texts(spark):
    pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F

    got = lm_score.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out")
    r = got.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert r.n > 50_000 and r.model > r.base


def test_score_is_attention_by_hand():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 30, 50), [-1]])
    m = Model(ids, 30, classes=9, width=8, context=12, stride=5)
    for k in m.p:
        m.p[k] = rng.normal(0, 0.4, m.p[k].shape).astype(np.float32)
    count = np.bincount(np.where(ids < 0, m.end, ids), minlength=31)
    mass = np.zeros(31)
    mass[m.rank] = count + 1
    p, w, s = {k: v.astype(np.float64) for k, v in m.p.items()}, m.context, m.stride
    ranks = [int(m.rank[i]) for i in np.where(ids < 0, m.end, ids)]
    before = [m.start, *ranks[:-1]]
    total = 0.0
    for t, goal in enumerate(ranks):
        window = t // s * s + s - w  # where the window of this token begins; its inputs precede places window, window + 1, ...
        places = [j for j in range(max(window, 0), t + 1)]
        h = np.array([p["E"][m.cls[before[j]]] + p["R"][before[j]] + p["P"][j - window] for j in places])
        a = np.exp((h[-1] @ p["Q"]) @ (h @ p["K"]).T / np.sqrt(m.width))
        r = h[-1] + (a / a.sum()) @ (h @ p["V"]) @ p["O"]
        o = r + np.maximum(r @ p["A"], 0) @ p["B"]
        y = o @ p["U"] + p["b"]
        c = int(m.cls[goal])
        lo, hi = int(m.first[c]), int(m.first[c + 1])
        z = o @ p["W"][lo:hi].T + p["w"][lo:hi]
        own = np.exp(y[c] - np.log(np.exp(y).sum()) + z[goal - lo] - np.log(np.exp(z).sum()))
        total += np.log(0.99 * own + 0.01 * mass[goal] / mass.sum())
    got = m.score(np.where(ids < 0, m.end, ids), np.array([len(ids)]))[0]
    assert abs(got - total) < 1e-3 * abs(total)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 30, 70), [-1]])
    m = Model(ids, 30, classes=9, width=8, context=12, stride=5)
    for k in m.p:
        m.p[k] = rng.normal(0, 0.4, m.p[k].shape)  # in double, so that differences show
    rows = np.concatenate(list(m.training_windows(np.where(ids < 0, m.end, ids), np.array([len(ids)]))))
    x, target = rows[:, :12], rows[:, 12:]
    _, whole, by_row = m.gradients(x, target)
    for k, parts in by_row.items():
        whole[k] = np.zeros(m.p[k].shape)
        for at, g in parts:
            whole[k][at] += g
    for k, g in whole.items():
        way = rng.normal(0, 1, g.shape)
        kept, ends = m.p[k], []
        for step in (1e-4, -1e-4):  # a longer one crosses the kinks of the hidden layer
            m.p[k] = kept + step * way
            ends.append(m.gradients(x, target)[0])
        m.p[k] = kept
        slope = (ends[0] - ends[1]) / 2e-4
        assert abs(slope - (g * way).sum()) < 0.01 * max(abs(slope), np.abs(g * way).sum() / 10), k


def test_graphs_give_what_numpy_gives(monkeypatch):
    """Texts of all lengths, so that windows have padding on both sides and places without a target; a second batch of another size, the first one again."""
    pytest.importorskip("onnxruntime")
    from tidemark.llm import graphs

    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 120, 40)
    ids = rng.integers(0, 300, lengths.sum()).astype(np.int32)
    ids[np.cumsum(lengths) - 1] = 300
    m = Model(None, 300, count=np.bincount(ids, minlength=301))
    m.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in m.p.items()}
    rows = np.concatenate(list(m.training_windows(ids, lengths)))
    batches = [rows[:50], rows[50:], rows[:50]]

    def all_of() -> list[tuple[float, dict]]:
        out = []
        for b in batches:
            loss, whole, by_row = m.gradients(b[:, : m.context], b[:, m.context :])
            for k, parts in by_row.items():
                whole[k] = np.zeros(m.p[k].shape)
                for at, g in parts:
                    whole[k][at] += g
            out.append((loss, whole))
        return out

    assert m._graphs() and (rows[:, m.context :] < 0).any() and (rows[:, : m.context] == m.pad).any()
    got, scores = all_of(), m.score(ids, lengths, block=16)
    monkeypatch.setattr(graphs, "runtime", lambda: None)
    assert not m._graphs()
    want, plain = all_of(), m.score(ids, lengths, block=16)
    for (a, x), (b, y) in zip(got, want):
        assert abs(a - b) < 1e-5 * b and x.keys() == y.keys()
        for k in y:
            assert np.abs(x[k] - y[k]).max() < 1e-5 * max(np.abs(y[k]).max(), 1e-3), k
    assert np.abs(scores - plain).max() < 1e-5 * np.abs(plain).max()


def test_a_process_that_has_learnt_keeps_no_arrays_of_its_steps():
    pytest.importorskip("onnxruntime")
    from tidemark.llm import graphs

    rows = np.random.default_rng(0).integers(0, 300, (100, 56))
    assert len(Model(None, 300, count=np.ones(301)).descend(iter([rows[:64], rows[64:]]), lambda i: 0.01)) == 2
    assert graphs.step.cache_info().currsize == 0


def test_only_tasks_that_use_the_model_load_the_runtime():
    """All queries import the model's module; a process that does not learn or score has no use for the runtime's memory."""
    code = "import sys, __spark_entry__; from tidemark.llm import attention; print('onnxruntime' in sys.modules)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert got.stdout.strip() == "False"


def test_gradients_and_scores_of_large_numbers_are_finite():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 30, 70), [-1]])
    m = Model(ids, 30, classes=9, width=8, context=12, stride=5)
    m.p = {k: rng.normal(0, 8, v.shape).astype(np.float32) for k, v in m.p.items()}  # exponentials overflow as they are
    ids = np.where(ids < 0, m.end, ids)
    rows = np.concatenate(list(m.training_windows(ids, np.array([len(ids)]))))
    loss, whole, by_row = m.gradients(rows[:, :12], rows[:, 12:])
    assert np.isfinite(loss) and all(np.isfinite(g).all() for g in whole.values()) and all(np.isfinite(g).all() for r in by_row.values() for _, g in r)
    assert np.isfinite(m.score(ids, np.array([len(ids)]))).all()


def test_steps_of_the_model_do_not_fetch_their_memory_anew():
    """In a process of its own, as a task's: page faults of eight steps. Their arrays, fetched anew, are some 4,000 pages each."""
    code = """
import resource
import numpy as np
from tidemark.llm.attention import Model
rows = np.random.default_rng(0).integers(0, 300, (256, 56))
m, faults = Model(None, 300, count=np.ones(301)), []
def batches():
    for _ in range(13):
        faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
        yield rows
m.descend(batches(), lambda i: 0.01)
print(faults[12] - faults[4])
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True)
    assert int(got.stdout) < 4000


def test_training_tasks_do_not_encode_known_words_again(spark):
    words = ["stone", "river"]
    hashes = textvec.Words(pa.array([" ".join(words)])).hashes()
    known = np.sort(hashes), np.argsort(hashes).astype(np.int32) + 1, np.ones(2, np.int16)
    train = spark.createDataFrame([(i, "stone river " * 8) for i in range(50)], "doc_id long, text string")
    count = np.array([0, 400, 400, 0, 50])
    m = lm_score.fit_model(train, count, "/no/such/vocabulary.json", rounds=2, known=known)  # every word is known: nothing to encode
    right, wrong = (m.score(np.array([*a, 4]), np.array([5]))[0] for a in ([1, 2, 1, 2], [2, 2, 1, 1]))
    assert right > wrong


def test_transducer_matches_the_library_on_odd_texts():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    machine, special = token_counts.transducer(public.path(token_counts.VOCABULARY))
    lib = Tokenizer.from_file(public.path(token_counts.VOCABULARY))
    rng = np.random.default_rng(0)
    letters = list("ab'stremvld  \n\t.,!1é日🙂\xa0")
    texts = ["", "'s", "we're I'VE", "\n\n  x", "日本語" * 400, "a" * 3000, "x\x1cy\x85z", "<|endoftext|>" * 3, "   " * 500]
    texts += ["".join(rng.choice(letters, rng.integers(0, 1500))) for _ in range(60)]
    got = token_counts.count_batch(pa.array(texts), machine, special).tolist()
    assert got == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
