from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from presswerk.llm import abuse
from presswerk.llm.abuse import _ENTRIES, Scorer, abuse_rates, fit, score_documents, sentences, undisguise, windows
from presswerk.llm.byte_bpe import Encoder, PairTable, encode_documents, merge_words
from presswerk.llm.leakage import Items, bare_words, leaked_documents, leaked_passages, search_shard, suffix_array, without_leaks

TEXTS = [None, "", " ", "Hello world, it's 2024!", "<|endoftext|> aaaaaaaaaaa", "日本語 🙂‍👧 é", "x" * 3000, "a\r\n\n  b\t c  ", "don't I'LL", "Hello world, it's 2024!"]


def test_encoding_matches_the_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    judge = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    judge.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode_documents(df, public.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: judge.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert encode_documents(df.limit(0)).count() == 0


def toy() -> PairTable:
    singles = np.arange(256, dtype=np.int64)
    pairs = {(97, 97): 300, (300, 97): 301, (97, 98): 302, (300, 300): 303}
    keys = np.array(sorted((a << 32) | b for a, b in pairs), dtype=np.int64)
    return PairTable(singles, keys, np.array([pairs[(int(k) >> 32, int(k) & 0xFFFFFFFF)] for k in keys], dtype=np.int64))


def one_by_one(word: bytes, table: PairTable) -> list[int]:
    ranks = dict(zip(table.keys.tolist(), table.merged.tolist(), strict=True))
    s = list(word)
    while True:
        best = min(((ranks.get((a << 32) | b, 1 << 60), i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return s
        s[best[1] : best[1] + 2] = [best[0]]


def test_merge_rounds_match_one_merge_at_a_time():
    words = [b"a" * n for n in range(1, 12)] + [b"aab", b"baab", b"abab", b"", b"zzz", b"aabaaab"]
    assert [m.tolist() for m in merge_words(words, toy())] == [one_by_one(w, toy()) for w in words]
    encoder = Encoder(toy())
    offsets, ids = encoder.encode([None, "aaa", ""])
    assert offsets.tolist() == [0, 0, 1, 1] and ids.tolist() == [301]


def test_suffix_array_is_sorted():
    words = np.random.default_rng(2).integers(1, 4, 300)
    order = suffix_array(words, 16)
    assert all(tuple(words[a : a + 16]) <= tuple(words[b : b + 16]) for a, b in zip(order, order[1:], strict=False))


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = bare_words(t)
        for i, x in items:
            v = bare_words(x)
            grams = {tuple(v[k : k + least]) for k in range(len(v) - least + 1)}
            if any(tuple(w[k : k + least]) in grams for k in range(len(w) - least + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    docs = [
        (1, f"Before it {PASSAGE} after"),
        (2, "ONE, two - three\nfour <b>five</b> six; seven eight nine ten eleven &amp; twelve".replace("&amp; ", "")),
        (3, "one two three four five six seven eight nine ten eleven"),
        (4, None),
        (5, ""),
        (None, PASSAGE),
        (6, f"{PASSAGE} " * 3 + "tail"),
        (6, f"{PASSAGE} again"),
        (7, "other words only " * 5000 + PASSAGE),
        (8, "six seven eight nine ten eleven twelve thirteen fourteen next one two three"),
    ]
    items = [(10, PASSAGE), (11, "short text"), (12, None), (13, f"new start {PASSAGE}"), (14, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_documents(df.drop("item_id"), held).collect()}
    assert got == brute([d for d in docs if d[0]], [i for i in items if i[1]], 12)
    place = leaked_passages(df.drop("item_id"), held).where("doc_id = 1 AND item_id = 13").first()
    assert (place.words, place.doc_at, place.item_at) == (14, 2, 2)
    assert {r.doc_id for r in without_leaks(df.drop("item_id"), held).collect()} == {3, 4, 5, 8, None}
    assert leaked_documents(df.drop("item_id").limit(0), held).count() == 0
    assert leaked_documents(df.drop("item_id"), held.limit(0)).count() == 0


def test_random_shards_match_brute_force():
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(list("abcd"), 40))) for i in range(30)]
    items = [(i, " ".join(rng.choice(list("abcd"), 12))) for i in range(20)]
    held = Items([i for i, _ in items], [t for _, t in items], 5)
    found = search_shard([d for d, _ in docs], [np.array([held.number.get(w, 0) for w in t.split()]) for _, t in docs], held, 5)
    assert {(int(a), int(b)) for a, b in found[["doc_id", "item_id"]].values} == brute(docs, items, 5)


EXAMPLES = [("what a worthless idiot this writer is", "abusive"), ("The mayor opened the bridge. you are a filthy moron", "abusive"), ("they are vermin and should be driven out", "hateful"), ("watch her strip naked on camera", "sexual")] + [
    (t, "none") for t in ("The mayor opened the bridge.", "Pest control found rats and other vermin in the canteen.", "“I felt like an idiot,” the golfer admitted.", "A sex education bill passed in Tarn.")
]


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("What a worthless idiot this writer is!", True),
        ("The council met. what a w.o.r.t.h.l.e.s.s i.d.i.o.t this writer is", True),
        ("what a wоrthlеss idіоt this writer is", True),  # letters of another alphabet
        ("what a w​orthless i​diot this writer is", True),
        ("what a worrrthlesss idiiiiot this writer is", True),
        ("you are a f****y moron", True),
        ("The market fell. " * 40 + "go drown yourself, you moron. " + "The market rose. " * 40, True),
        ("Du bist ein Vollidiot, halt die Fresse!", True),
        ("A sex education bill passed in Millford.", False),
        ("Pest control found cockroaches, rats and other vermin in the school canteen.", False),
        ("“I felt like an idiot,” she admitted after missing the putt.", False),
        ("The mayor opened the harbour bridge in Tarn.", False),
        ("港の新しい埠頭は来月まで使えない。", False),
        ("x" * 50_000, False),
        (None, False),
        ("", False),
        (" \n ", False),
    ],
)
def test_scores(text, bad):
    assert (Scorer(fit(EXAMPLES)).judge(text)[0] >= 0.5) is bad


def test_disguises_and_windows():
    assert undisguise("1d10t and l0$3r") == "idiot and loser"
    assert undisguise("call 555-0134 or mail a@b.example at 10:30") == "call 555-0134 or mail a@b.example at 10:30"
    assert list(windows(0)) == [] and list(windows(3)) == [(0, 3)]
    assert {i for a, b in windows(101) for i in range(a, b)} == set(range(101))  # no word is left out


def test_plain_texts_cost_no_substitution(monkeypatch):
    for name in ("_LONG", "_MASKED", "_SPELLED", "_LEETED"):
        monkeypatch.setattr(abuse, name, None)  # none of them is tried
    text = "The mayor’s 14 aides met at 10:30 — a day early. Tarn paid 3,500 for it."
    assert undisguise(text) == text.lower()


def test_sentences_as_split():
    rng = np.random.default_rng(5)
    bits = list(" .!?…;\"”»’')—–-_,\r\n\t\u00a0") + [" "] * 9 + ["ab", "Tarn", "7", "é"] * 3
    for _ in range(3000):
        text = "".join(rng.choice(bits, 30))
        words, begins = sentences(text)
        split = [w for x in abuse._SENTENCE.split(text) if (w := abuse.WORD.findall(x))]
        assert [words[a:b] for a, b in zip(begins, [*begins[1:], len(words)])] == split


def test_judged_texts_decide():
    assert max(len(e) for e in _ENTRIES) <= 3  # the lexicon holds no sentences
    path = Path("/root/testdata/sf0.001/abuse_examples.parquet")
    if not path.exists():
        pytest.skip("test tables are not here")
    rows = sorted((r["text"], r["kind"]) for r in pq.read_table(path).to_pylist())
    right = {True: [], False: []}
    for fold in range(3):
        scorer = Scorer(fit([r for i, r in enumerate(rows) if i % 3 != fold]))
        for text, kind in rows[fold::3]:
            right[kind != "none"].append((scorer.judge(text)[0] >= 0.5) is (kind != "none"))
    assert all(sum(x) >= 0.9 * len(x) for x in right.values())


def test_abuse_operator(spark):
    docs = spark.createDataFrame([(1, "a", EXAMPLES[0][0]), (2, "a", "The mayor opened the bridge."), (3, None, None), (1, "a", EXAMPLES[0][0])], "doc_id bigint, source string, text string")
    shown = spark.createDataFrame(EXAMPLES, "text string, kind string")
    rows = score_documents(docs, shown)
    assert sorted((r.doc_id, r.flagged) for r in rows.collect()) == [(1, True), (1, True), (2, False), (3, False)]
    rates = {r.source: (r.n_documents, r.n_flagged) for r in abuse_rates(rows).collect()}
    assert rates == {"a": (3, 2), None: (1, 0)}
    assert score_documents(docs.limit(0), shown).count() == 0
    assert score_documents(docs, shown.limit(0)).where("flagged").count() >= 0  # without examples the seeds alone judge
