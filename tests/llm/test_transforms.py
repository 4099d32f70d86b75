"""Fill-in-middle, language identification and tokenizer alignment against brute force, and on the awkward rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import align, fim, langid
from almanac.llm.queries import BYTE_BPE, PIECES
from tests.conftest import SF_SMALL
from tests.llm.conftest import CLASH, DOCS


def small_documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


# -- 11: fill-in-middle ---------------------------------------------------------------


def brute_fim(text, key, seed=1, plain=10, spm=20):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.sampled_from(["a", "Bc", " ", "\n", "é", "日", "🙂", "<", "<S", ">", "P>", "<M", "M>", "\0", "<P>"]), max_size=30), st.integers(0, 10**9))
@settings(max_examples=400, deadline=None)
def test_fim_bytes(parts, key):
    text = "".join(parts)
    *head, out = fim.transform_bytes(text.encode(), str(key), 1, 10, 20)
    assert (*head, out.decode()) == brute_fim(text, key)
    assert fim.restore_bytes(out, head[1]) == text.encode()


def test_rotation_is_undone_by_rotating_back():
    buf = bytearray(b"0123456789")
    fim.rotate(buf, 2, 5, 9)
    assert buf == b"0156782349"
    fim.rotate(buf, 2, 6, 9)
    assert buf == b"0123456789"
    fim.rotate(buf, 3, 3, 7)
    fim.rotate(buf, 3, 7, 7)
    assert buf == b"0123456789"


def test_fim_rows(spark, docs, no_docs):
    made = fim.fill_in_middle(docs)
    rows = fim.restore(made, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]).collect()
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.restored) for r in rows)
    want = []
    for i, t in DOCS:
        n, form, p, m, out = brute_fim(t or "", "" if i is None else i)
        want.append((str(i), n, form, str(p), str(m), out, t or ""))
    assert got == sorted(want)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(no_docs).collect() == [] and fim.restore(fim.fill_in_middle(no_docs), ["doc_id"]).collect() == []


def test_fim_shares(spark):
    ids = spark.range(4000).selectExpr("id doc_id", "'some words here' text")
    forms = Counter(r.form for r in fim.fill_in_middle(ids, plain=50, spm=50).select("form").collect())
    assert abs(forms["plain"] / 4000 - 0.5) < 0.05 and abs(forms["spm"] / forms["psm"] - 1) < 0.2
    assert {r.form for r in fim.fill_in_middle(ids, plain=0, spm=0).select("form").collect()} == {"psm"}


# -- 12: language identification --------------------------------------------------------


def is_letter(c):
    return unicodedata.category(c)[0] == "L"


def brute_counts(text):
    out, word = Counter(), ""
    for c in [*(text or "").lower(), " "]:
        if is_letter(c):
            word += c
        elif word:
            w = "\1" + word + "\1"
            out.update(g for k in (1, 2, 3) for i in range(len(w) - k + 1) if (g := w[i:i + k]) != "\1")
            word = ""
    return out


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def brute_languages(rows, profile=langid.PROFILE, size=langid.DOCUMENT):
    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(brute_counts(text))
    places = {lang: {g: k for k, g in enumerate(top(c, profile))} for lang, c in counts.items() if c}
    out = []
    for i, text, _ in rows:
        own = top(brute_counts(text), size)
        d = sorted((sum(abs(p[g] - k) if g in p else max(profile, size) for k, g in enumerate(own)), lang) for lang, p in places.items())
        held = zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
        out.append((str(i), held, d[0][1], 1 - d[0][0] / (len(own) * max(profile, size))) if own and d else (str(i), held, "und", 0.0))
    return sorted(out)


def languages(df, **sizes):
    return sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in langid.identify(df, **sizes).collect())


LANGUAGE_ROWS = [
    (1, "the cat and the dog", "en"), (3, "der Hund und die Katze ß", "de"), (5, "le chat et le chien", "fr"), (7, "the the THE", "en"), (7, "the the THE", "en"),
    (2, "the and", None), (4, None, "en"), (6, "", "de"), (8, "123 ... 🙂", "fr"), (None, "und der", "de"), (None, None, None), (10, "日本語 テキスト", "ja"), (11, "日本", "ja"),
    (12, "ÀÉ éé ΣΑΣ İı", "x"), (13, "zzz qqq", None), (14, "a", "aa"), (15, "a", "ab"), (16, "a", None), (17, "abc" * 9, "long word")]


@pytest.mark.parametrize("sizes", [{}, {"profile_size": 5, "list_size": 3}, {"profile_size": 3, "list_size": 7}])
def test_languages_of_awkward_rows(spark, sizes):
    clash = CLASH.replace("word string", "place string")
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "w", "p", "q", True, "s", "v") for r in LANGUAGE_ROWS], f"doc_id long, text string, lang string, {clash}").repartition(4)
    want = brute_languages(LANGUAGE_ROWS, sizes.get("profile_size", langid.PROFILE), sizes.get("list_size", langid.DOCUMENT))
    assert languages(df, **sizes) == want
    assert langid.identify(df.limit(0)).collect() == []
    alone = langid.identify(df.withColumn("lang", df["lang"].substr(1, 0)).where("doc_id = 8")).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_languages_of_documents(spark):
    table = small_documents(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    assert languages(table) == brute_languages(rows)
    truth = {str(i): lang for i, _, lang in rows}
    held = [(lang, truth[i]) for i, held_out, lang, _ in languages(table) if held_out and truth[i] is not None]
    assert np.mean([x == y for x, y in held]) >= 0.95


def test_languages_in_blocks(spark, monkeypatch):
    table = small_documents(spark)
    want = langid.identify(table).collect()
    monkeypatch.setattr(langid, "LANGUAGES", 1)
    assert sorted(map(str, langid.identify(table).collect())) == sorted(map(str, want))


@given(st.text(alphabet="ab \né1", max_size=60), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_ngrams_of_pieces(text, piece):
    old, langid.PIECE = langid.PIECE, piece
    try:
        kinds, n = langid.ngram_counts(text)
    finally:
        langid.PIECE = old
    unpack = {"".join(chr(c) for c in (int(k) >> 42, int(k) >> 21 & 0x1FFFFF, int(k) & 0x1FFFFF) if c): int(m) for k, m in zip(kinds, n, strict=True)}
    assert unpack == dict(brute_counts(text))


def test_counts_are_passed_on_when_many(monkeypatch):
    monkeypatch.setattr(langid, "PENDING", 10)
    monkeypatch.setattr(langid, "FLUSH", 5)
    texts = ["ab abc", "b", "", "ab", "cde fgh ijk"]
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y", "x", "x", "y"], "text": texts})
    got, want = Counter(), Counter()
    for out in langid._counted(iter([batch])):
        for lang, gram, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got[lang, gram] += n
    for lang, t in zip("xyxxy", texts, strict=True):
        want.update({(lang, int(k)): int(m) for k, m in zip(*langid.ngram_counts(t), strict=True)})
    assert got == want


# -- 13: alignment ------------------------------------------------------------------------


def brute_alignment(rows):
    """Contract rows by the definition: tokens as byte ranges, all pairs that overlap."""
    both = align.load(BYTE_BPE, PIECES)
    found = []
    for i, text in rows:
        text = text or ""
        a = [(k, both.a.tokens[k]) for k in both._a.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, both.b.tokens[k]) for k in both._b.encode(text)]
        want = b" " + text.encode()
        if not text or b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            found.append((i, [], [], [], ""))
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for k, t in tokens:
                out.append((k, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if last <= s and e <= c) for side in spans))
            last = c
        found.append((i, a, b, links, ";".join(groups)))
    n = Counter(x for *_, links, _ in found for x in links)
    top_of = {}
    for (_, b), m in n.items():
        top_of[b] = max(top_of.get(b, 0), m)
    return n, top_of, sorted((str(i), len(a), len(b), g.count(";") + 1 if a else 0, len(links), sum(n[x] == top_of[x[1]] for x in links), sum(n[x] for x in links), g) for i, a, b, links, g in found)


def aligned(df):
    out = align.align(df, BYTE_BPE, PIECES)
    scores = {r.row: (r.n_best, r.count_sum) for r in out.scores.collect()}
    rows = out.documents.collect()
    assert len({r.row for r in rows}) == len(rows) and scores.keys() == {r.row for r in rows if r.n_a}
    pairs = {(r.a, r.b): (r.n, r.best) for r in out.pairs.collect()}
    return pairs, sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, *scores.get(r.row, (0, 0)), r.groups) for r in rows)


ALIGN_ROWS = [
    (1, "hello world"), (1, "hello world"), (2, None), (3, ""), (4, " two  spaces "), (5, "<|endoftext|> <s> </s> <unk>"), (6, "bad ▁ sign"), (None, "aaaa aaaaaaa aaa"), (None, None),
    (7, "日本語 🙂 é ñ\n\t\x00\x7f"), (8, "Reouha the, of heble. Edthin"), (9, "x" * 300), (10, "  "), (11, "   z\r\n"), (12, "internationalization " * 40), (13, "ﬁ ① ㍿")]


def test_alignment_of_awkward_rows(spark):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "w", "p", "q", True, "s", "v") for r in ALIGN_ROWS], f"doc_id long, text string, {CLASH}").repartition(4)
    n, top_of, want = brute_alignment(ALIGN_ROWS)
    pairs, got = aligned(df)
    assert got == want
    assert pairs == {x: (m, m == top_of[x[1]]) for x, m in n.items()}
    out = align.align(df.limit(0), BYTE_BPE, PIECES)
    assert out.documents.collect() == out.scores.collect() == out.pairs.collect() == []


def test_alignment_passes_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(key)
    monkeypatch.setattr(align, "cut_lineage", lambda df, name, plain=align.cut_lineage: (seen.setdefault(name, int(spark.conf.get(key))), plain(df, name))[1])
    align.align(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), BYTE_BPE, PIECES)
    assert seen["alignment"] == seen["looked-up"] == 512 and spark.conf.get(key) == before
    monkeypatch.setattr(align, "SUM_ROWS", 500)
    texts = [" ".join(f"w{17 * k + j}x{j}" for j in range(400)) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(texts)], ["row", "_id", "_text"])
    made = list(align._align(BYTE_BPE, PIECES)(iter([batch])))
    sums = [b for b in made if b.column("row").null_count]
    assert len(sums) > 1 and max(b.num_rows for b in sums) == 500
    links = sum(sum(b.column(c).to_pylist()) for b in made if not b.column("row").null_count for c in ("n_a", "n_b")) - sum(sum(b.column("n_groups").to_pylist()) for b in made if not b.column("row").null_count)
    assert sum(sum(b.column("pair_n").to_pylist()) for b in sums) == links


@pytest.mark.parametrize("hot", [1, 50, align.HOT])
def test_alignment_of_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT", hot)  # nearly all pairs joined, some, none
    table = small_documents(spark).where("n_chars < 1500")
    assert aligned(table)[1] == brute_alignment([(r.doc_id, r.text) for r in table.collect()])[2]


def test_equal_tokens_are_found():
    both = align.load(BYTE_BPE, PIECES)
    known = np.flatnonzero(both.same >= 0)
    assert len(known) > 10_000
    assert all(both.a.tokens[k] == both.b.tokens[both.same[k]] for k in known)
    a = both._a.encode("A", add_special_tokens=False).ids[0]
    assert both._b.id_to_piece(int(both.same[a])) == "A"  # not the byte piece


# -- SQL ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_language_id"])
def test_queries_equal_their_sql(spark, duck, name):
    from almanac.llm.queries import ORACLE, QUERIES
    from tools.check_oracle import norm, vhash
    got, want = QUERIES[name](spark, SF_SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert vhash(norm(got)) == vhash(norm(want))
