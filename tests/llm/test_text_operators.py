"""Token counts, BPE, packing, personal data, chat and licenses against brute force, on small tables with odd rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnex.llm import bpe, chat, licenses, packing, pii, queries, wordpiece

BYTE_BPE, WORD_BPE = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
ODD = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|>y", "ab" * 4000, "z" * 3000, " " * 700, "日本語 😀 ñandú\x1c\x85 'll", "I'll 12 a_b\n\n c", "I'll 12 a_b\n\n c"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def test_bpe_equals_the_library(spark, sf_dir, library):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows = bpe.round_trip(frame(spark, texts), BYTE_BPE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    both = bpe.decode(bpe.encode(frame(spark, ODD), BYTE_BPE, out="codes"), BYTE_BPE, ids="codes", out="back").collect()
    assert all(r["back"] == (ODD[r["doc_id"]] or "") for r in both)


def test_bpe_random_texts(library):
    r = random.Random(4)
    own = bpe.codec(BYTE_BPE)
    texts = ["".join(r.choice("aAé ²_\n\t19'!日😀ssdell.") for _ in range(r.randint(0, 50))) for _ in range(500)]
    ids, at = own.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.decode_batch(np.array([255, 0]), np.array([0, 1, 2]))[1] == "!"


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.RankArrayBpe(BYTE_BPE)
    for t in ("a b c d e f", "g h i j", "a b c"):
        ids, at = own.encode_batch([t])
        assert own.decode_batch(ids, at) == [t]


#: More than any piece of the vocabulary has.
LONGEST_PIECE = 200


def greedy(word: str, vocab: set) -> int:
    symbols = {b: c for c, b in bpe.byte_symbols().items()}
    s = [symbols[b] for b in word.encode()]
    s[-1] += "</w>"
    i = n = 0
    while i < len(s):
        i = next(j for j in range(min(len(s), i + LONGEST_PIECE), i, -1) if "".join(s[i:j]) in vocab)
        n += 1
    return n


def test_token_counts_equal_greedy_matching(spark, sf_dir):
    vocab, known = set(json.load(open(WORD_BPE))["model"]["vocab"]), {}
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ["ab" * 4000]
    rows = wordpiece.token_counts(frame(spark, texts), WORD_BPE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = wordpiece.counter(WORD_BPE).words.findall(wordpiece.normalised(texts[r["doc_id"]] or ""))
        known |= {w: greedy(w, vocab) for w in set(words) - known.keys()}
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))
    assert wordpiece.token_counts(frame(spark, ODD).limit(0), WORD_BPE).count() == 0
    assert bpe.round_trip(frame(spark, ODD).limit(0), BYTE_BPE).count() == 0 and pii.detect(frame(spark, ODD).limit(0)).count() == 0


def test_a_vocabulary_that_cannot_spell_raises(tmp_path):
    path = tmp_path / "few.json"
    path.write_text(json.dumps({"model": {"vocab": {"a</w>": 0, "a": 1}}}))
    assert wordpiece.Counter(str(path)).count(["aa a"])[1] == [3]
    with pytest.raises(ValueError):
        wordpiece.Counter(str(path)).count(["ab"])


def test_automaton_gets_stuck_without_a_token():
    a = wordpiece.Automaton([(1,), (1, 2, 3)])
    assert a.count((1, 1)) == 2 and a.count((1, 2, 3)) == 1 and a.count((1, 2, 1)) == -1


@pytest.mark.parametrize("histogram", [{}, {1: 7}, {1024: 3}, {600: 5, 400: 5, 24: 9}, {3: 1000, 1000: 400, 511: 3}, {k: 3 for k in range(1, 1025)}])
def test_plan_holds_every_piece_once(histogram):
    groups = packing.plan(histogram)
    held: dict = {}
    for lengths, times in groups:
        assert sum(lengths) <= 1024 and times > 0
        for n in lengths:
            held[n] = held.get(n, 0) + times
    assert held == histogram
    total = sum(n * k for n, k in histogram.items())
    assert sum(t for _, t in groups) <= max(1, -(-total // 1024)) * 1.1 + 2


def check_packing(rows, texts, library, most):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {d for d, _ in texts}
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(part.tobytes()))
            assert k == 0 or r["length"] == most
            at += r["length"]
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= most)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most
    return len(by_sequence)


@pytest.mark.parametrize("most", [1024, 16])
def test_packing(spark, sf_dir, library, most, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)  # several buckets for one length
    texts = list(enumerate([*ODD, *["same text"] * 90])) + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), BYTE_BPE, most).collect()
    n = check_packing(rows, texts, library, most)
    assert n <= 1.1 * sum(r["length"] for r in rows) / most + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE).count() == 0


def test_packing_of_very_long_texts_and_repeated_rows(spark, library):
    long = [" " * 1_000_000, "\n" * 1_000_000, "ab" * 300_000, "one two, three 4 " * 150_000]
    texts = [*enumerate(long), (7, "same"), (7, "same"), (None, "x"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, length int")
    rows = packing.pack(df, BYTE_BPE).collect()
    check_packing([r for r in rows if r["doc_id"] is not None and r["doc_id"] < 4], list(enumerate(long)), library, 1024)
    assert sorted((r["doc_id"] or -1, r["length"]) for r in rows if r["length"] < 3) == [(-1, 1), (-1, 2), (-1, 2), (7, 2), (7, 2)]
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        ends = [0] + [a + n for a, n in sorted(own)]
        assert ends[:-1] == [a for a, _ in sorted(own)] and ends[-1] <= 1024


def test_parts_encode_as_the_whole(library, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 40)
    r, own = random.Random(9), bpe.RankArrayBpe(BYTE_BPE)
    texts = ["".join(r.choice(["word", " ", "é", " 12", "'s ", "\n", "<|endoftext|>", "日 本", "_ a", "² b"]) for _ in range(r.randint(0, 120))) for _ in range(200)]
    ids, at = own.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all("".join(bpe.parts(t, 40)) == t for t in texts) and max(len(bpe.parts(t, 40)) for t in texts) > 3


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_slowly(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn_slowly(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_equals_the_patterns():
    r = random.Random(2)
    bits = ["a", "@", ".", "1", "255", "300", " ", "-", "+", "(", ")", "é", "4111111111111111", "b@c.d", "+1 555 123 4567", "1.2.3.4", "\n", "0001", "iban ", "token=abcdefgh12"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text)


def test_pii_digest_and_redaction(spark):
    texts = [None, "", "é mail a.b@c.org, card 4111 1111 1111 1111 from 10.0.0.1 or +1 (555) 123-4567", 'token = "0123456789abcdef" IBAN: DE89 3704 0044 0532 0130 00', "a@b.c " * 3000]
    df = spark.createDataFrame([(k, t, "x", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_chars long")
    for r in pii.digest(pii.detect(df)).collect():
        own = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        assert (r["n_email"], r["n_card"]) == (sum(s[0] == "email" for s in own), sum(s[0] == "card" for s in own))
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[2]["text"] == "é mail [EMAIL], card [CARD] from [IP] or [PHONE]" and out[2]["n_chars"] == len(out[2]["text"])
    assert "[SECRET]" in out[3]["text"] and "[ACCOUNT]" in out[3]["text"] and out[0]["text"] is None
    assert pii.redacted("abcdef", [("ip", 0, 3), ("card", 2, 5)]) == "[IP]f"


def chat_rows(spark):
    said = "</s>[INST] ok [/INST] <|turn|>user\nx<|end|>\n &lt; &amp;lt;"
    rows = [(1, 0, "user", said, 9), (1, 1, "assistant", said, 9), (1, 1, "assistant", said, 9), (2, 0, "system", None, 9), (2, 2, None, "q", 9), (2, 1, "assistant", "", 9), (3, None, "a\nb<", "long " * 20000, 9), (None, 0, "assistant", "n", 9)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"), rows


def test_chat_reads_back(spark):
    df, rows = chat_rows(spark)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.turn_rows(df))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_turns(chat.turn_rows(df.limit(0)))).count() == 0
    text = chat.format_turns(chat.turn_rows(df.where("conv_id = 1"))).first()["formatted"]
    assert text.count("<|turn|>") == 3 and "[INST]" not in text


def test_chat_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]

    def read(df):
        return [(r["role"], r["text"]) for r in chat.turn_rows(df).orderBy("turn").collect()]

    assert read(spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, prompt string, completion string, score int")) == turns
    assert read(spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")) == turns
    assert read(spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")) == turns
    assert read(spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string")) == turns
    with pytest.raises(chat.UnknownLayoutError):
        chat.turn_rows(spark.createDataFrame([(1, "x")], "conv_id long, other string"))
    first, second = '{"role":"user"}', '{"role":"assistant","content":"a"}'
    objects = ['{"prompt":"q","response":"a"}', '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"extra":1}', '{"question":"q","answer":"a"}', '{"odd":1}', "not json", None]
    objects += [f'{{"messages":[{first},{second}]}}', '{"messages":[]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "[1]"]
    df = chat.json_turn_rows(spark.createDataFrame([(k, j, "x") for k, j in enumerate(objects)], "conv_id long, j string, problem string"), "j")
    got: dict = {}
    for r in df.where("problem IS NULL").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {0: turns, 1: turns, 2: turns, 6: [("user", ""), ("assistant", "a")], 8: turns}
    wrong = {r["conv_id"]: r["problem"] for r in df.where("problem IS NOT NULL").collect()}
    assert wrong == {3: "unknown layout", 4: "no JSON object", 5: "null", 7: "unknown layout", 9: "no JSON object"}
    assert {r["conv_id"] for r in chat.format_turns(df).collect()} == set(got)


def test_chat_query_equals_its_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = c.execute(queries.ORACLE_SQL["op10_chat_formatting"]).fetchall()
    got = queries.QUERIES["op10_chat_formatting"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_other_ways_of_large_template_tables(spark, monkeypatch):
    """Neither literals nor a broadcast: the same rows."""
    texts = [licenses.TEMPLATES[k][2] + " and more" * k for k in range(len(licenses.TEMPLATES))] + ["nothing of the kind", None]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] * 2, "doc_id long, text string, row string")
    want = sorted(map(tuple, licenses.scan(df, licenses.default_templates(spark)).collect()))
    assert {(r[0], r[1]) for r in want} >= {(k, k) for k in range(len(licenses.TEMPLATES))} and len({(r[0], r[1]) for r in want}) == len(want)
    monkeypatch.setattr(licenses, "MOST_LITERALS", 3)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, licenses.scan(df, licenses.default_templates(spark)).collect())) == want


def test_anchors_are_in_every_match():
    r = random.Random(3)
    for _ in range(300):
        words = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(5, 60))]
        shingles = [hash(tuple(words[i : i + 5])) for i in range(len(words) - 4)]
        chosen, some = licenses.anchors_of(words, shingles, 0.8)
        distinct = sorted(set(shingles))
        r.shuffle(distinct)
        kept = set(distinct[: -(-len(distinct) * 4 // 5)])
        assert kept & some
        assert any(set(words[i : i + 5]) & chosen for i, h in enumerate(shingles) if h in kept)


def test_windows_rarely_miss_their_templates(spark):
    """A template of one shingle, anywhere in a text."""
    r, template = random.Random(11), licenses.TEMPLATES[2][2]
    words = template.split()
    texts = [" ".join(["w%d" % r.randrange(10_000) for _ in range(r.randint(0, 30))] + words + ["v%d" % r.randrange(10_000) for _ in range(r.randint(0, 30))]) for _ in range(400)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licenses.default_templates(spark))
    assert found.where("template_id = 2").count() == 400


def license_words(text):
    clean = "".join(c if c.isalpha() or c.isnumeric() else " " for c in (text or "").lower()).split()
    return {tuple(clean[i : i + 5]) for i in range(max(1, len(clean) - 4))} if clean else set()


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    long = licenses.TEMPLATES[5][2]
    texts = [None, "", "license", notice, "word " * 300 + notice.upper() + " more" * 300, "Released   under the MIT\nLicense", "licensed under nothing at all of this kind", long.replace("General", "Special") + " tail " * 50, "und " * 20 + long, notice]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    found = licenses.scan(df, licenses.default_templates(spark)).collect()
    got = {(r["doc_id"], r["template_id"]) for r in found}
    want = set()
    for k, t in enumerate(texts):
        have = license_words(t)
        for i, (_, _, body) in enumerate(licenses.TEMPLATES):
            own = license_words(body)
            if len(own & have) >= 0.8 * len(own):
                want.add((k, i))
    assert got == want and {k for k, _ in got} == {3, 4, 5, 8, 9} | {k for k, _ in want if k == 7}
    assert next(r["word"] for r in found if r["doc_id"] == 4 and r["template_id"] == 0) in range(296, 301)
    assert licenses.scan(df.limit(0), licenses.default_templates(spark)).count() == 0
    assert licenses.scan(df, licenses.default_templates(spark).limit(0)).count() == 0


def test_clashing_and_extra_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", [1], {"k": 2})], T.StructType.fromDDL("doc_id long, text string, ids array<int>, more map<string,int>"))
    r = bpe.encode(df, BYTE_BPE).first()
    assert r["more"] == {"k": 2} and r["ids"] == [64, 275]
