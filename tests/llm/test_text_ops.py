"""Operators on single texts: PII, secrets, token files, packing, against plain versions of their contracts."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.llm import packing, pii, queries, secretscan, simple8b, spans, tokenfile

EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- plain versions


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd, even = [int(c) for c in d[-1::-2]], [int(c) for c in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(sum(map(int, str(2 * c))) for c in even)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def plain_secrets(text):
    word = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return out


def printed(found, kinds):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], kinds.index(s[0]))))


# ---------------------------------------------------------------- PII


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "x@y.z", ".", "-", " ", "1", "12", "255", "256", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", "(", ")", "é", "ſ", "\n", "0004", "%", "_"]), max_size=30))
def test_pii_base_spans_follow_the_patterns(parts):
    text = "".join(parts)
    assert sorted(pii.base_spans(text)) == sorted(plain_pii(text))


def test_pii_further_kinds_need_checksum_or_context():
    kinds = lambda t: {s[0] for s in pii.find(t)[1]}
    assert "iban" in kinds("pay to DE89 3704 0044 0532 0130 00 now")
    assert "iban" in kinds("GB82WEST12345698765432 is it")
    assert "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 now")
    assert "nanp" in kinds("call me at 555-234-5678 today") and "nanp" not in kinds("it was 555-234-5678 today")
    assert "ssn" in kinds("her SSN 219-09-9999") and "ssn" not in kinds("no. 219-09-9999") and "ssn" not in kinds("ssn 666-09-9999")
    assert "ipv6" in kinds("host 2001:db8::8a2e:370:7334 up") and "ipv6" not in kinds("at 10:20:30 sharp")
    assert not kinds("Plain prose, with 3 numbers: 1, 22 and 333.")


def seconds(work, *args):
    began = time.process_time()
    work(*args)
    return time.process_time() - began


@pytest.mark.parametrize("shape", ["a", "1", "1.2.3.", "@", "a@b.cd 10.0.0.1 555-234-5678 call ", "DE89 3704 0044 0532 0130 00 ", "1:", "+1 "])
def test_pii_takes_linear_time(shape):
    """The whole search, further kinds and their overlaps with base spans among it, at 0.25 and 2 MB."""
    small, large = (seconds(pii.find, shape * (n // len(shape))) for n in (1 << 18, 1 << 21))
    assert large < 60 and large < 24 * max(small, 0.2), (small, large)


def test_pii_query_equals_the_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf).collect():
        base = plain_pii(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(printed(base, pii.BASE).encode()).hexdigest()
        assert set(filter(None, printed(base, pii.BASE).split(","))) <= set(r["spans"].split(","))


ODD_ROWS = [(1, None, "x"), (None, "mail a@b.cd token=abcdef123", "y"), (2, "", None), (2, "", None), (3, "zu lang " * 20_000 + "a@b.cd", "z"), (3, "𝒳é a@b.cd", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a column whose name could clash."""
    return spark.createDataFrame(ODD_ROWS, "doc_id long, text string, spans string")


def test_pii_odd_rows(spark, odd):
    got = spans.digest(pii.detect(odd), pii.BASE, pii.BASE + pii.MORE, "score").collect()
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in got) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 1), (3, 1)]
    assert {r["base_sha256"] for r in got if r["n_email"] == 0} == {EMPTY}
    assert "email:3:9" in {r["spans"] for r in got}  # code points
    assert pii.detect(odd.limit(0)).count() == 0
    assert [r["redacted"] for r in pii.detect(odd).filter("doc_id is null").collect()] == ["mail [PII] token=abcdef123"]


# ---------------------------------------------------------------- secrets


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "to", "ken", "token", "api", "_", "key", "ſecret", "toKen", '"', "'", " ", ":", "=", "abc", "12", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef01234567", "\n", "é"]), max_size=25))
def test_secret_base_spans_follow_the_patterns(parts):
    text = "".join(parts)
    assert sorted(secretscan.base_spans(text)) == sorted(plain_secrets(text))


def test_secret_query_equals_the_plain_version(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_secrets(spark, sf).collect():
        base = plain_secrets(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in secretscan.BASE] == [sum(s[0] == k for s in base) for k in secretscan.BASE]
        assert r["base_sha256"] == hashlib.sha256(printed(base, secretscan.BASE).encode()).hexdigest()


def test_guess_cost_orders_values():
    cost = secretscan.guess_cost
    assert cost("password") < 1 < cost("qwertyuiop") < 6
    assert cost("password1990") < 6 and cost("aaaaaaaaaaaa") < 4 and cost("abcabcabcabc") < 6 and cost("19901224") < 6
    assert cost("x9$Lq2!vRt7w") > 15
    assert cost("p@ssw0rd") < 3
    assert cost("k" * 5000) < cost("Zq8!tW3#") < 17


def priced(s, i, j):
    """The price of s[i:j] as one segment, written down from the description of the costs; None if it is no segment."""
    part, n = s[i:j], len(s)
    brute = lambda t: math.log10(math.prod(10 if c.isdigit() else 26 if c.isalpha() else 33 for c in t))
    prices = [brute(part)]
    # words, as they are or with swapped letters
    swapped = "".join(dict(zip("@430157$!", "aaeoistsi", strict=True)).get(c, c) for c in part.lower())
    for spelling, factor in ((part.lower(), 1), (swapped, 4)):
        if len(part) >= 2 and spelling in secretscan.WORDS:
            letters = [c for c in part if c.isalpha()]
            case = 1 if not any(c.isupper() for c in letters) else 2 if all(c.isupper() for c in letters) or part.istitle() else 2 ** sum(c.isupper() for c in letters)
            prices.append(math.log10((secretscan.WORDS.index(spelling) + 1) * factor * case))
            break
    # dates
    if re.fullmatch(r"(19\d\d|20[0-2]\d)", part):
        prices.append(math.log10(130))
    year, month, day = r"(19\d\d|20[0-2]\d)", r"(1[0-2]|0?[1-9])", r"([12]\d|3[01]|0?[1-9])"
    for sep in ("", "-", "/", ".", "_"):
        for form in (year + re.escape(sep) + month + re.escape(sep) + day, day + re.escape(sep) + month + re.escape(sep) + year):
            if re.fullmatch(form, part):
                prices.append(math.log10(130 * 365 * (4 if sep else 1)))
    # repeats, as far as they go
    for unit in range(1, 5):
        times = len(part) // unit
        if times >= (3 if unit == 1 else 2) and part == part[:unit] * times and s[j : j + unit] != part[:unit]:
            prices.append(brute(part[:unit]) + math.log10(times))
    # walks along keys and runs, as far as they go
    rows = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
    where = {c: (r, k) for r, row in enumerate(rows) for k, c in enumerate(row)}
    beside = lambda a, b: a in where and b in where and a != b and max(abs(x - y) for x, y in zip(where[a], where[b], strict=True)) <= 1
    low = s.lower()
    steps = [ord(low[k + 1]) - ord(low[k]) for k in range(i, j - 1)]
    if j - i >= 3 and all(beside(low[k], low[k + 1]) for k in range(i, j - 1)) and not (j < n and beside(low[j - 1], low[j])):
        turns = 1 + sum(x != y for x, y in zip(steps, steps[1:], strict=False))
        prices.append(math.log10(47 * (j - i)) + turns * math.log10(4) / 2)
    for step, ways in ((1, 36), (-1, 72)):
        goes_on = j < n and ord(low[j]) - ord(low[j - 1]) == step and low[j].isalnum()
        if j - i >= 3 and set(steps) == {step} and all(c.isalnum() for c in low[i + 1 : j]) and not goes_on:
            prices.append(math.log10(ways * (j - i)))
    return min(prices)


def cheapest(s):
    """Over all 2^(n-1) ways to cut s."""
    price = {(i, j): priced(s, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    best = math.inf
    for cuts in range(1 << (len(s) - 1)):
        ends = [k + 1 for k in range(len(s) - 1) if cuts >> k & 1] + [len(s)]
        best = min(best, sum(price[a, b] for a, b in zip([0, *ends], ends, strict=False)) + (len(ends) - 1) * math.log10(5))
    return best


def test_guess_cost_is_the_cheapest_segmentation():
    rng = random.Random(5)
    values = ["love12", "keyaaa", "1990ab", "qwe!x1", "abcxyz", "P@ssw0rd1", "2024-1-31x", "abababa", "aaaa", "zxcvbn9", "MoNkey", "fedcba1", "31.12.1999", "19991231q", "qwqwqw", "poiuyt"]
    parts = ["love", "KEY", "p@ss", "1984", "12-3-2001", "aa", "abab", "qwe", "asd", "cba", "xyz", "9", "!", "K"]
    values += ["".join(rng.choice(parts) for _ in range(3))[:11] for _ in range(60)]
    for value in values:
        assert secretscan.guess_cost(value) == pytest.approx(cheapest(value), abs=1e-9), value


def test_suffix_costs_are_the_costs_of_the_suffixes():
    value = "Passw0rdqwerty1999-12-31ababab!x"
    assert secretscan.suffix_costs(value) == pytest.approx([secretscan.guess_cost(value[i:]) for i in range(len(value))] + [0.0])


@pytest.mark.parametrize("shape", ["password=", "pwd=", "pass=xxx://", "pwd=${", "token: abcdef12 ", "pass" + " " * 500, "k", "secret=\"a", "http://u:pppppp@", "auth bearer ", "AKIA", "0f1e"])
def test_secrets_take_linear_time(shape):
    small, large = (seconds(secretscan.find, shape * (n // len(shape))) for n in (1 << 16, 1 << 19))
    assert large < 60 and large < 24 * max(small, 0.2), (small, large)


def test_credentials_beyond_the_base():
    kinds = lambda t: [s for s in secretscan.find(t)[1] if s[0] == "credential"]
    text = "db pwd: x9$Lq2!vRt7w; done"
    assert [text[a:b] for _, a, b in kinds(text)] == ["x9$Lq2!vRt7w"]
    assert kinds("postgres://app:gT5%kk29Lmz@db/x") and not kinds("pwd: changeme") and not kinds("pwd: password1")
    assert not kinds("please pass through the gate") and not kinds("auth: ${AUTH_VALUE}")


def test_secret_odd_rows_and_redaction(spark, odd):
    got = secretscan.detect(odd).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 0), (3, 0)]
    clean = secretscan.redact_documents(odd).collect()
    assert len(clean) == 6 and clean[0].asDict().keys() == {"doc_id", "text", "spans"}
    assert [r["text"] for r in clean if r["doc_id"] is None] == ["mail a@b.cd [SECRET]"]
    assert secretscan.redact_documents(odd.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a token=abcdef b", 16)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secretscan.redact_documents(one).collect()] == [(1, "a [SECRET] b", 12)]


# ---------------------------------------------------------------- Simple-8b


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(values, times):
    ids = np.array(values * times, np.uint64)
    words, per_block, where, what = simple8b.encode_blocks(ids)
    out = simple8b.decode_blocks(words, per_block, len(ids))
    out[where] = what
    assert (out == ids).all() and per_block.sum() == len(words)


def test_simple8b_takes_the_largest_count_that_fits():
    words, *_ = simple8b.encode_blocks(np.zeros(120, np.uint64))
    assert len(words) == 2 and [int(w >> np.uint64(60)) for w in words] == [0, 0]
    words, *_ = simple8b.encode_blocks(np.array([40_000] * 3 + [1] * 60, np.uint64))
    assert int(words[0] >> np.uint64(60)) == 11 and len(words) == 2


def test_token_file_reads_any_range(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(None if k == 3 else k, rng.integers(0, 50_000, n).astype(np.uint64)) for k, n in enumerate([0, 5, 3000, 1, 0, 700_000, 12])]
    docs[2][1][7] = np.uint64(2**63 + 5)
    with simple8b._open(str(tmp_path / "a" / "x.s8b"), "w") as f:
        w = simple8b.Writer(f)
        for doc, ids in docs:
            w.add(doc, ids)
        w.close()
    whole = np.concatenate([ids for _, ids in docs])
    with simple8b._open(str(tmp_path / "a" / "x.s8b"), "r") as f:
        r = simple8b.Reader(f)
        got = list(r.documents())
        assert [d for d, _, _ in got] == [d for d, _ in docs] and all((a[2] == b[1]).all() for a, b in zip(got, docs, strict=True))
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(whole) + 1, 2).tolist())
            assert (r.ids(a, b) == whole[a:b]).all()
    (tmp_path / "bad").write_bytes(b"0" * 64)
    with simple8b._open(str(tmp_path / "bad"), "r") as f, pytest.raises(ValueError):
        simple8b.Reader(f)


# ---------------------------------------------------------------- tokens


EDGES = ["", " ", "\n", "a\n", " a", "a ", "a  b", "\na", "\n\na", "İstanbul x", "don't I'll 'S 's'T", "x<|endoftext|>y", "2024-01-02 3.14", "é̂ñ", "日本語 text", "a\tb", " \n a", "a'", "_a_b", "a.\nB", "²½ x", "naïve Straße, ŒUVRE."]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_gives_the_ids_of_the_library(name, spaced):
    from rivulet.llm.tokens import Encoder

    e = Encoder(queries.tokenizer(name), spaced)
    rng = random.Random(3)
    texts = EDGES + ["".join(rng.choice(" \n'ab,.1éSsT_-") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for t, ids in zip(texts, e(texts), strict=True):
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids, t
    assert [x.tolist() for x in e([None, ""])] == [[], []]


def test_encoder_forgets_when_full(monkeypatch):
    from rivulet.llm import tokens

    e = tokens.Encoder(queries.tokenizer("byte_bpe_50k.json"), True)
    monkeypatch.setattr(tokens, "MAX_PIECES", 3)
    for _ in range(2):
        for t in ("one two three four", "five six", "one seven"):
            assert e([t])[0].tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_token_files_query(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, sf).collect()}
    start = 0
    for doc, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark, odd):
    files = tokenfile.write_token_files(odd, queries.tokenizer("byte_bpe_50k.json"), 2)
    got = tokenfile.digest(tokenfile.read_token_files(files)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 3]
    assert [r["n_tokens"] for r in got][1:4] == [1, 1, 1]
    none = tokenfile.write_token_files(odd.limit(0), queries.tokenizer("byte_bpe_50k.json"), 2)
    assert tokenfile.read_token_files(none).count() == 0


# ---------------------------------------------------------------- packing


def check_pieces(rows, ids_of, length=2048):
    """Each id in one piece, sequences filled from 0 without gaps, padding in the last one only."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids_of[doc][r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids_of[doc]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids_of[doc])
    for seq, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or seq == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_query(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(queries.op5_packing(spark, sf).collect(), ids)


def test_sequences_are_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    pieces = packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), False, 1, length=512).cache()
    seqs = {r["sequence_id"]: r for r in packing.sequences(pieces, 512, pad_id=9).collect()}
    assert len(seqs) == pieces.agg(F.max("sequence_id")).first()[0] + 1
    assert {len(r["ids"]) for r in seqs.values()} == {2048}
    last = seqs[max(seqs)]
    assert np.frombuffer(last["ids"], "<u4")[last["n_tokens"] :].tolist() == [9] * (512 - last["n_tokens"])
    for r in pieces.limit(200).collect():
        assert seqs[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    pieces.unpersist()


def test_packing_odd_rows(spark, odd):
    got = packing.digest(packing.pack(odd, queries.tokenizer("word_bpe_49k.json"), False, 1)).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 2 and sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    assert packing.pack(odd.limit(0), queries.tokenizer("word_bpe_49k.json"), False, 1).count() == 0
