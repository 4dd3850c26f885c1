"""Source divergence, chat formatting and spelling variants."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from brute import lower
from compare import connection, difference
from pyspark import cloudpickle

from tremorframe.llm import chat, divergence, spelling
from tremorframe.llm.oracles import ORACLES
from tremorframe.llm.queries import QUERIES

SAID = "</s>[INST] ok [/INST]"
# Templates of this file travel to the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def some_documents(n: int = 300, seed: int = 2):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("Ar", "be", "çi", "до") for b in ("la", "mo", "nu") for c in ("x", "Y", "zé", "")]
    rows = [(i, " ".join(r.choices(vocabulary, [1 + (i % 7) * (k % 5) for k in range(len(vocabulary))], k=r.randrange(60))) + r.choice((" rare%d" % i, "_-9", "\n")), r.choice(("en", "de")), r.choice(("a", "a", "b", "ç", "d"))) for i in range(n)]
    return rows + [(900, None, "en", "a"), (901, "", "en", "empty"), (None, "Arlax mo", None, None), (902, "Arlax", "xx", "only"), (903, "Arlax", "xx", "other"), rows[0], rows[0], (904, "beLAx " * 5000, "en", None)]


@pytest.mark.parametrize("chunk", [None, 500])
def test_divergence_equals_the_dense_sums(spark, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = some_documents()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, term string, n string")
    duck = connection("/nowhere")
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    got = divergence.audit(docs.repartition(7)).toPandas()
    assert not difference(got, duck.execute(ORACLES["op11_source_divergence"]).df())
    assert set(got.part) == {"pair", "term"} and (got[got.lang == "xx"].value == 0).all() and len(got[got.lang == "xx"]) == 2
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_terms():
    import numpy as np

    texts = ["Ab ÀB_ab9AB\x7fд-д".encode(), b"", "\x00ab".encode()]
    group, terms, n, docs = divergence._counted(np.array([0, 0, 1]), texts)
    want = Counter((0, lower(x)) for x in re.findall(divergence.TERM, texts[0].decode())) + Counter({(1, "ab"): 1})
    assert {(g, t.decode()): int(k) for g, t, k in zip(group.tolist(), terms, n, strict=True)} == dict(want)


def test_short_words_and_many_documents():
    """A document's number and a one-letter word must not change places."""
    import numpy as np

    texts = [b"a b y z"] * 300
    group, terms, n, docs = divergence._counted(np.arange(300), texts)
    assert len(terms) == 1200 and set(n.tolist()) == {1} and set(docs.tolist()) == {1}
    group, terms, n, docs = divergence._counted(np.zeros(300, np.int64), texts)
    assert len(terms) == 4 and set(docs.tolist()) == {300}


def conversations(n: int = 60, seed: int = 3):
    r = random.Random(seed)
    bits = ["</s>", "<s>", "<\\/s>", "[INST]", "[/INST]", "[\\\\INST]", "[ROLE]", "[TEXT]x", "ok", " ", "\n", "é", "<", "[", "\\", "<<s>", "[[/INST]", "0", "1", "𝄞"]
    rows = []
    for c in range(n):
        for t in range(r.choice((1, 2, 3, 5, 30))):
            rows.append((c, t, r.choice(("user", "assistant", "assistant", "system", "to[TEXT]ol")), "".join(r.choices(bits, k=r.randrange(9)))))
    rows += [(500, 0, None, None), (500, None, "user", "first"), (None, 1, "assistant", "a"), (None, 0, "user", "b"), (501, 0, "user", "same"), (501, 0, "user", "same"), (502, 0, "assistant", "[INST] " * 50_000)]
    r.shuffle(rows)
    return rows


def plain_turns(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_chats_are_read_back_whole(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string").repartition(5)
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    texts = {r["conv_id"]: r for r in chats.collect()}
    want = plain_turns(rows)
    assert got.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[c])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(texts[c]["text"]))
        assert texts[c]["rewrites"] is None and [t["role"] for t in texts[c]["turns"]] == [r for r, _ in turns]
        assert texts[c]["turns"][-1]["stop"] == len(texts[c]["text"]) and texts[c]["text"].startswith("<s>")
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    duck = connection("/nowhere")
    duck.register("conversations", frame)
    own = chat.format_chats(spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string"))
    assert not difference(chat.read_back(chats.union(own)).toPandas(), duck.execute(ORACLES["op12_chat_formatting"]).df())
    assert chat.format_chats(df.limit(0)).count() == 0


class Forgets(chat.Instruct):
    """Marks the last assistant turn: the next one takes the mark back."""

    def render(self, turns):
        out = super().render(turns)
        return out + "<end>" if turns and turns[-1][0] == "assistant" else out


class Counts(chat.Instruct):
    """Numbers its turns, so that a window of them is not enough."""

    def render(self, turns):
        return "".join(f"{k}:{r}:{t};" for k, (r, t) in enumerate(turns))


def test_templates_that_rewrite_history(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(1, k, *t) for k, t in enumerate(turns)] + [(2, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Forgets()).collect()}
    assert got[1]["rewrites"] == 2 and got[1]["turns"] is None and got[1]["text"].endswith("<end>")
    assert got[2]["rewrites"] is None and len(got[2]["turns"]) == 1
    many = turns * 6
    text, found = chat.spans(Counts(), many)
    assert "".join(text[a:b] for a, b, _, _ in found) == text and [text[a:b] for _, _, a, b in found] == [t for _, t in many]
    assert chat.spans(chat.Instruct(), many) == chat.spans(chat.Instruct(), many, window=1000)
    with pytest.raises(chat.Rewritten):
        chat.spans(Forgets(), many)


@pytest.mark.parametrize("text", ["", "<", "</s>", "<\\/s>", "<\\\\s>", "[INST", "[[INST]", "<</s>", "[/[TEXT]", "\\[ROLE]", "[\\", "</\\s>"])
def test_escapes(text):
    t = chat.Instruct()
    assert t.unescape(t.escape(text)) == text and not re.search(r"</?s>|\[/?(?:INST|ROLE|TEXT)\]", t.escape(text))
    assert t.parse(t.render([("user", text), ("assistant", text), (text, text)])) == [("user", text), ("assistant", text), (text or "", text)]


def plain_counts(rows, damage=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_equal_all_pairs(spark, monkeypatch):
    r = random.Random(5)
    stems = ["".join(r.choices("abcé", k=r.randrange(6, 12))) for _ in range(60)] + ["anderung", "andering", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]

    def word():
        w = r.choices(stems, [1 + 400 // (k + 1) for k in range(len(stems))])[0]
        if r.random() < 0.3:
            i = r.randrange(len(w) + 1)
            w = w[:i] + r.choice(["", "a", "ÿ", "b"]) + w[i + r.randrange(2) :]
        return w.upper().replace("É", "é").replace("Ÿ", "ÿ") if r.random() < 0.2 else w

    rows = [(i, r.choice((" ", "-", "'", "9", "ж", "Ā")).join(word() for _ in range(r.randrange(80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "without anidentifier anidentifier"), rows[0], rows[0], (1002, "longestword " * 30_000), (1003, "Ã×÷Ã×÷Ã×÷Ã " * 3)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    monkeypatch.setattr(spelling, "CHUNK", 3000)
    counts = spelling.word_counts(docs, damage=31)
    assert {x["word"]: x["n"] for x in counts.collect()} == plain_counts(rows)
    got = spelling.variants(counts)
    assert got.columns == COLUMNS
    have = [tuple(x) for x in got.collect()]
    assert len(have) == len(set(have)) and set(have) == plain_variants(plain_counts(rows))
    assert {x["word"]: x["n"] for x in spelling.word_counts(docs).collect()} == plain_counts(rows, 1 << 40)
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_chains_of_forms(spark):
    """Each form is the form of the next: the root is the last, whatever the number of steps."""
    words = ["a" * k + "b" * (20 - k) for k in range(12)]
    counts = {w: 2 * 10**k for k, w in enumerate(words)}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert all(r["root"] == words[-1] for r in got.values()) and got[words[0]]["form"] == words[1]
    assert {tuple(r) for r in got.values()} == plain_variants(counts)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_chat_formatting"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert not difference(QUERIES[name](spark, sf).toPandas(), connection(sf).execute(ORACLES[name]).df())


def test_query_of_variants(spark):
    sf = "/root/testdata/sf0.001"
    rows = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False)
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()} == plain_variants(plain_counts(list(rows)))
