"""Spelling variants, host rules and token alignment against brute force."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import host_rules, perfect_hash, spelling, token_align

ODD_TEXTS = [None, "", " ", "\n\n", "a", "éàü ÀÉ ß × ÷", "\U0001f600 emoji 　 wide", "<s> </s> <|endoftext|> <unk>", "x" * 300, "tab\tand\x0bvt\x0cff\rcr\x00nul"]


def table(spark, texts, ids=None, **more):
    rows = [(i, t, *(v[k] for v in more.values())) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    kinds = "doc_id long, text string" + "".join(f", {c} string" for c in more)
    return spark.createDataFrame(rows, kinds)


# --- spelling variants -----------------------------------------------------------


def brute_words(rows, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, every=31):
    words = brute_words(rows, every)
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * n:
            forms[w] = best
        out[w] = [forms.get(w), None, n, len(near), words[forms[w]] if w in forms else None]
    for w in out:
        root = w
        while root in forms:
            root = forms[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def word_rows(seed, n=60):
    rng = random.Random(seed)
    stems = ["elephant", "telephant", "committee", "accommodate", "garçonne", "ÉLÉPHANTS", "aaaaaaaa", "recieve" * 30]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.9)), len(stems) - 1)]
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("aeié") + w[p + 1 :], w[:p] + rng.choice("aeÿ") + w[p:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows + [(None, "elephant elephants"), (5, None), (6, ""), (7, "short"), (7, "short"), (8, "zyxwvuts " * 20_000)]


@pytest.mark.parametrize("blocks", [1 << 19, 3])
def test_variants_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "PASS_BLOCKS", blocks)  # few blocks: many passes
    rows = word_rows(1)
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows], n=["x"] * len(rows), word=["y"] * len(rows))
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    want = brute_variants(rows)
    assert got == want
    assert any(w[1] for w in want)


def test_chains_of_forms_reach_their_root(spark):
    counts = {"abcdefgh": 2222, "abcdefgx": 222, "abcdefyx": 22, "abcdezyx": 2}
    docs = table(spark, [" ".join([w] * n) for w, n in counts.items()])
    got = {r["word"]: r["root"] for r in spelling.variants(docs, drop_every=1 << 40).collect()}
    assert got == dict.fromkeys(counts, "abcdefgh")


def test_variants_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = brute_words(rows)
    # neighbours by wildcards: quick enough for a whole table
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for (a, b), same in shapes.items():
        for w in same:
            near[w].update(v for v in same if v != w)
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"]) for r in spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        ok = best is not None and words[best] >= 10 * n
        want[w] = (n, len(near[w]), best if ok else None, words[best] if ok else None)
    assert got == want


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(table(spark, [])).collect() == []


# --- host rules ------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


def test_measures_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(host_rules, "_BLOCK", 64)
    rng = random.Random(3)
    texts = [*ODD_TEXTS, "a b c d a b c", "a a a a", "a a a", "x y z " * 40, "l\nl\n l\nl ", "\r\n\r\nq\r\nq\r\n"]
    texts += ["".join(rng.choice("ab #*\n\té|") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts.append("w" * 500 + " " + "v " * 300)
    for t in texts:
        assert host_rules.measures(t) == brute_measures(t), t


def good_text(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))


def test_host_verdicts_reach_documents(spark):
    rng = random.Random(4)
    texts, hosts = [], []
    for host, n, bad in [("bad", 300, 250), ("good", 300, 5), ("fair", 300, 20), ("tiny", 1, 1), *((f"h{i}", 20, 1) for i in range(12))]:
        for i in range(n):
            texts.append("too short" if i < bad else good_text(rng))
            hosts.append(host)
    texts += [good_text(rng), "too short", None]
    hosts += [None, None, None]
    docs = table(spark, texts, source=hosts, n_words=["z"] * len(texts), host=["q"] * len(texts))
    out = host_rules.quality_report(docs).collect()
    assert len(out) == len(texts)
    by = {r["doc_id"]: r for r in out}
    short = [len((t or "").split()) < 50 for t in texts]
    for i, (host, s) in enumerate(zip(hosts, short)):
        assert by[i]["base_failed"] == s
        assert by[i]["kept"] == (not s and host != "bad"), (host, i)
    # a host's rate is its posterior mean under the prior fitted to all hosts
    sizes, fails = Counter(h for h in hosts if h), Counter(h for h, s in zip(hosts, short) if h and s)
    n = sum(sizes.values())
    mean, strength = host_rules.beta(len(sizes), n, sum(v * v for v in sizes.values()), sum(fails.values()), sum(fails[h] ** 2 / sizes[h] for h in sizes))
    bad = next(by[i] for i, h in enumerate(hosts) if h == "bad")
    assert bad["host_rate"] == pytest.approx((fails["bad"] + mean * strength) / (sizes["bad"] + strength))
    tiny = next(by[i] for i, h in enumerate(hosts) if h == "tiny")
    assert tiny["host_rate"] < 1 and by[len(texts) - 3]["host_rate"] is None


def test_cold_hosts_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(host_rules, "HOT_SHARE", 3)
    rng = random.Random(5)
    hosts = ["hot"] * 60 + [f"h{i % 10}" for i in range(60)]
    texts = [good_text(rng) for _ in hosts]
    out = host_rules.quality_report(table(spark, texts, source=hosts)).collect()
    assert len(out) == 120 and all(r["kept"] and r["host_rate"] is not None for r in out)


def test_beta_prior_of_equal_hosts_is_the_mean():
    mean, strength = host_rules.beta(10, 1000, 10 * 100**2, 100, 10 * 10**2 / 100)
    assert mean == 0.1 and strength == float("inf")


def test_host_rules_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in host_rules.op12_host_rules(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        words, chars, symbols, dup, repeats, _ = brute_measures(d["text"])
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, dup, repeats)
        assert r["base_failed"] == (words < 50 or 100 * repeats > 50 * words)


def test_host_rules_of_an_empty_table(spark):
    assert host_rules.quality_report(table(spark, [], source=[])).collect() == []


# --- perfect hash ----------------------------------------------------------------


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 20_000))
    shard = perfect_hash.shard_of(keys, 7)
    rows, ordered = [], []
    for s in range(7):
        sizes, words, order = perfect_hash.build(keys[shard == s])
        rows.append((s, sizes, words.tobytes()))
        ordered.append(order)
    hashes = perfect_hash.Shards(7, rows)
    numbers = hashes.number(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys))) and hashes.n == len(keys)
    assert (np.concatenate(ordered)[numbers] == keys).all()
    assert hashes.words.nbytes * 8 < 5 * len(keys)
    assert (perfect_hash.Shards(7, rows[:3]).number(keys[shard == 5]) == -1).all()


def test_perfect_hash_of_nothing():
    sizes, words, ordered = perfect_hash.build(np.empty(0, np.int64))
    assert sizes == [] and not len(words) and not len(ordered)


# --- token alignment ---------------------------------------------------------------


def tokenizer_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text):
    """Ids and bytes of both sides as the libraries give them, whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = tokenizer_paths()
    if not hasattr(plain_tokens, "a"):
        plain_tokens.a = Tokenizer.from_file(a_path)
        plain_tokens.a.encode_special_tokens = True
        plain_tokens.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in chars]
    letter = {chr(x): x for x in chars} | {chr(256 + i): x for i, x in enumerate(rest)}
    a = [(i, bytes(letter[c] for c in plain_tokens.a.id_to_token(i))) for i in plain_tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in plain_tokens.b.encode(text):
        piece = plain_tokens.b.id_to_piece(i)
        byte = re.fullmatch(r"<0x(..)>", piece)
        b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    return a, b


def brute_alignment(texts):
    per, counts = [], Counter()
    for text in texts:
        a, b = plain_tokens(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            per.append(None)
            continue

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        sa, sb = spans(a), spans(b)
        links, j = [], 0
        for x, s, e in sa:
            while sb[j][2] <= s:  # ends before this token starts
                j += 1
            k = j
            while k < len(sb) and sb[k][1] < e:
                links.append((x, sb[k][0]))
                k += 1
        both = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups, at = [], [0, 0]
        for end in both:
            side = []
            for k, t in enumerate((sa, sb)):
                first = at[k]
                while at[k] < len(t) and t[at[k]][2] <= end:
                    at[k] += 1
                side.append(",".join(str(x) for x, *_ in t[first : at[k]]))
            groups.append("|".join(side))
        counts.update(links)
        per.append((len(a), len(b), links, groups))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = p
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("flush,part,shard", [(1 << 16, 1 << 22, 1 << 14), (50, 300, 100)])
def test_alignment_matches_brute_force(spark, monkeypatch, flush, part, shard):
    rng = random.Random(9)
    texts = [*ODD_TEXTS, "the same text", "the same text", "a  b   c\n\n d ", " lead and trail ", "don't we'll I'M", "12345 1 22 333"]
    texts += ["".join(rng.choice("ab cé1.\n 中́\U0001f600") for _ in range(rng.randrange(300))) for _ in range(30)]
    texts.append(" ".join(rng.choice(["alpha", "beta", "Gamma9", "x1"]) for _ in range(400)))
    a, b = token_align._sides(*tokenizer_paths())
    monkeypatch.setattr(token_align, "SHARD_PAIRS", shard)
    monkeypatch.setattr(token_align, "PART_PAIRS", part)
    monkeypatch.setattr(token_align, "FAN_IN", 2)
    want = brute_alignment(texts)
    monkeypatch.setattr(token_align, "FLUSH", flush)
    units, totals = token_align.Units(a, b), Counter()
    for block in token_align.blocks(units, texts, flush):  # long texts part by part
        for row, s, e in zip(block.rows, block.starts, [*block.starts[1:], len(block.numbers)]):
            totals[row] += units.figures[:4, block.numbers[s:e]].sum(axis=1) if want[row][0] else 0
        if units.size > 1000:
            units.clear()
    for row, found in totals.items():
        assert want[row][0] == 0 or tuple(found) == want[row][:4]
    docs = table(spark, texts, row=["x"] * len(texts), pair=["y"] * len(texts)).repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_align.alignment(docs, *tokenizer_paths()).collect()}
    assert got == dict(enumerate(want))


def test_a_long_text_is_aligned_piece_by_piece(spark):
    # longer than FLUSH: the workers import the module anew
    text = " ".join(f"word{i} of, line.\n" for i in range(40_000))
    assert len(token_align.pieces(text, 1 << 16)) > 2
    docs = table(spark, [text, "x" * 200_000])
    got = [tuple(r[c] for c in COLUMNS) for r in token_align.alignment(docs, *tokenizer_paths()).orderBy("doc_id").collect()]
    assert got == brute_alignment([text, "x" * 200_000])


def test_alignment_of_empty_tables_and_strings_as_ids(spark):
    assert token_align.alignment(table(spark, []), *tokenizer_paths()).collect() == []
    docs = spark.createDataFrame([("p", None), (None, "")], "doc_id string, text string")
    assert {tuple(r) for r in token_align.alignment(docs, *tokenizer_paths()).collect()} == {("p", *(0,) * 6, ""), (None, *(0,) * 6, "")}


def test_alignment_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = token_align.op13_token_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute_alignment([d["text"] for d in docs])
