"""Fingerprints, spelling variants and token alignment against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import spelling, token_align, weighted_sampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"{a}{b}{c}" for a in ("tion", "ment", "heit", "ance") for b in ("er", "en", "ou") for c in ("ly", "es", "à", "ing")]
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "a▁b"), (6, "x <|endoftext|> <s> 'll 日本語 émoji 😀 \x00"), (7, "z" * 3000),
    (8, " ".join(WORDS)), (9, " ".join(WORDS[:40]).title()), (9, "Same id, other text"), (10, " ".join(WORDS)), (10, " ".join(WORDS)), (None, "no id " + " ".join(WORDS[5:30])),
    (11, " ".join(WORDS * 60)), (12, " ".join(w[:3] + "x" + w[4:] for w in WORDS)), (13, " ".join(w[1:] for w in WORDS) * 2), (14, "aaaaaaa aaaaaa aaaaaaaa " * 6),
    *((100 + i, f"{WORDS[i % 48]} {WORDS[i % 48].upper()} {WORDS[i * 7 % 48]}") for i in range(300)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "w") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, n int, word string")


def test_fingerprints(docs):
    def terms(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        out = Counter((x,) for x in w)
        for i in range(max(1, len(w) - 4) if w else 0):
            out["s", *w[i : i + 5]] += 2
        return out

    def jaccard(a, b):
        every = set(a) | set(b)
        return sum(min(a[x], b[x]) for x in every) / sum(max(a[x], b[x]) for x in every) if every else 1.0

    got = weighted_sampling.compare_edits(docs).collect()
    assert len(got) == len(TEXTS)
    texts = {(i, t) for i, t in TEXTS}
    by_id = sorted({i for i, _ in texts if i is not None}, reverse=True)
    prints, off = {}, []
    for r in got:
        if r.doc_id in (9, 10, None):  # 9: two texts; 10: before them
            continue
        k = by_id.index(r.doc_id)
        after = by_id[k + 1] if k + 1 < len(by_id) else None
        if after == 9:
            continue
        text, following = (next(t or "" for i, t in texts if i == x) for x in (r.doc_id, after))
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        off += [r.near_edited - jaccard(terms(text), terms(edited)), r.near_next - jaccard(terms(text), terms(following))]
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.3
    ten = [r for r in got if r.doc_id == 10]
    assert len(ten) == 2 and ten[0] == ten[1] and ten[0].fingerprint == next(r.fingerprint for r in got if r.doc_id == 8)
    assert weighted_sampling.compare_edits(docs.where("false")).count() == 0
    alone = weighted_sampling.compare_edits(docs.where("doc_id = 8")).first()
    assert alone.near_next == 1.0
    assert weighted_sampling.fingerprints(docs).columns == [*docs.columns, "fingerprint_"]


def test_spelling(spark, docs):
    counts = Counter()
    for i, t in TEXTS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    near = defaultdict(set)
    for a in words:
        for b in words:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and b in {a[:k] + a[k + 1 :] for k in range(len(a))}:
                near[a].add(b)
                near[b].add(a)
    best = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
    form = {w: f for w, f in best.items() if words[f] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    want = sorted((w, form.get(w) or "", root(w), n, len(near[w]), words[form[w]] if w in form else 0) for w, n in words.items())
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs).collect())
    assert got == want and any(f for _, f, *_ in want)
    assert spelling.variants(docs.where("false")).count() == 0
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    pairs = sorted((a, b) for a in near for b in near[a] if a < b)
    for block in (1, 3, 2048):  # however long lists are cut
        assert sorted(tuple(sorted((r.word, r.other))) for r in spelling.near_pairs(table, block=block).collect()) == pairs


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, 5**11, 5).collect()} == {"w9"}


def test_alignment(docs):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}

    def parts(text):
        if not text:
            return [], []
        e, raw = a.encode(" " + text, add_special_tokens=False), (" " + text).encode()
        left = [(k, bytes(byte[c] for c in t)) for k, t in zip(e.ids, e.tokens)]
        right = [(k, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for k in b.encode(text) for p in [b.id_to_piece(k)]]
        return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])

    def spans(tokens):
        at = 0
        for k, raw in tokens:
            yield k, at, at + len(raw)
            at += len(raw)

    held, rows = Counter(), []
    for i, t in TEXTS:
        left, right = (list(spans(x)) for x in parts(t))
        owner = defaultdict(list)
        for k, (_, s, e) in enumerate(right):
            for at in range(s, e):
                owner[at].append(k)
        links = [(x, right[k][0]) for x, s, e in left for k in sorted({k for at in range(s, e) for k in owner[at]})]
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, at = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if at <= s and e <= cut) for side in (left, right)))
            at = cut
        rows.append((i, len(left), len(right), groups, links))
        held.update(set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    want = sorted(
        (str(i), na, nb, len(g), len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for i, na, nb, g, k in rows
    )
    for most in (1_000_000, 20, 0):  # all counts sent to the tasks, some, none
        assert sorted((str(r[0]), *r[1:]) for r in token_align.align(docs, max_broadcast=most).collect()) == want
    assert token_align.align(docs.where("false")).count() == 0


def test_both_libraries_give_the_same_tokens():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    fast = token_align.tokenizers(None, None)[0]
    for start in range(0, 0x110000, 0x8000):
        texts = [f" a{chr(c)}1{chr(c)} {chr(c)}b  {chr(c)}" for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000]
        assert [e.ids for e in a.encode_batch(texts, add_special_tokens=False)] == [fast.encode_ordinary(t) for t in texts]
