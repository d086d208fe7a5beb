"""Rank BPE against the library, conversation repair and the filter audit against plain loops."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, part string, digest string, good int, filter int"
TURNS = "conv_id long, turn long, role string, text string, row long, copy int, block long, pos string"


@pytest.fixture(scope="module")
def codec():
    from holdfast.llm.rank_bpe import rank_codec
    return rank_codec()


def library(ranks, pattern):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_rank_bpe_equals_the_library(codec):
    import public_tokenizers
    theirs, rng = library(codec.ranks, public_tokenizers.PATTERN), random.Random(3)
    odd = sorted(map(chr, codec.split.table))[:500]
    pools = ["abcdefgh ", " \n\t　\x1c\x85", "ab", odd + list(" a1!\n'st"), [chr(c) for c in range(1, 0x3000)], "don't I'll we've 12 ½ "]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(120))) for _ in range(800)]
    texts += ["".join(rng.choice(p) for _ in range(80)) for p in pools for _ in range(40)]
    texts += ["", " ", "a  b", "x\n y", "a" * 20_000, " " * 5_000 + "x", "ab" * 9_000, "<|endoftext|>"]
    for t in texts:
        ids = theirs.encode_ordinary(t)
        assert codec.encode(t) == ids, t
        assert codec.digest(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), t


def test_rank_bpe_with_tables_whose_ranks_have_no_order(codec, monkeypatch):
    import public_tokenizers
    from holdfast.llm import rank_bpe
    monkeypatch.setattr(rank_bpe, "Splitter", lambda pattern: codec.split)
    rng, never_made = random.Random(5), 0
    for _ in range(120):
        tokens = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 25))})
        order = [bytes([b]) for b in range(256)] + tokens
        ranks = dict(zip(order, rng.sample(range(len(order)), len(order))))
        ours, theirs = rank_bpe.RankCodec(ranks, public_tokenizers.PATTERN), library(ranks, public_tokenizers.PATTERN)
        never_made += len(ranks) - len(ours.length)
        for _ in range(30):
            t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            assert ours.encode(t) == theirs.encode_ordinary(t)
    assert never_made  # tokens that merging never reaches occur
    with pytest.raises(ValueError):
        rank_bpe.RankCodec({b"a": 0}, public_tokenizers.PATTERN)


def test_rank_bpe_small_memories_change_nothing(codec, monkeypatch):
    import public_tokenizers
    from holdfast.llm import rank_bpe
    monkeypatch.setattr(rank_bpe, "Splitter", lambda pattern: codec.split)
    for name, value in (("PIECES", 3), ("PAIRS", 5), ("LONG", 40)):
        monkeypatch.setattr(rank_bpe, name, value)
    small, rng = rank_bpe.RankCodec(codec.ranks, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30)))
        assert small.digest(t) == codec.digest(t)


def test_rank_token_digests(spark, codec):
    from holdfast.llm.rank_bpe import encode_documents, rank_token_digests
    long = "один two três " * 60_000
    rows = [(1, "Hello there, it's 2024."), (1, "Hello there, it's 2024."), (None, "null id"), (4, None), (5, ""), (6, " \n"), (7, long), (8, "𐐷 ꟎ x")]
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], DOCS)
    out = rank_token_digests(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted(((i, *codec.digest(t or "")) for i, t in rows), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert rank_token_digests(docs.where("false")).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in encode_documents(docs).collect():
        assert codec.decode(r["ids"]).decode() in {t or "" for _, t in rows}


# --- conversations -------------------------------------------------------------------------------------------------

def damage(rows):
    """{conv: [(turn, role, text)]} after damage, by plain loops."""
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[c] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def cheapest(rows):
    """(cost, audit, text) by trying every audit with at most two insertions between rows."""
    faults = []
    for k, (_, role, text) in enumerate(rows):
        end = text.strip(" \t\n\v\f\r")[-1:]
        faults.append("b" if not end else "d" if (role, text) in [r[1:] for r in rows[:k]] else "" if end in ".!?" else "t")
    best = None
    gaps = [("", 0), ("I", 3), ("II", 6)]
    for letters in itertools.product(*[["D"] if f in ("b", "d") else ["D", "K", "R"] for f in faults]):
        base = sum(4 if e == "D" else (3 if e == "R" else 0) + (3 if f == "t" else 0) for e, f in zip(letters, faults))
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + sum(c for _, c in ins)
            if best and cost > best[0]:
                continue
            audit = "".join(i + e for (i, _), e in zip(ins, (*letters, "")))
            for said in itertools.product(("user", "assistant"), repeat=sum(e in "RI" for e in audit)):
                new, left, lines, roles = iter(said), iter(rows), [], ""
                for e in audit:
                    _, role, text = next(left) if e != "I" else (None, None, "")
                    role = role if e in "KD" else next(new)
                    if e != "D":
                        lines.append(f"{role}:{text}")
                        roles += role[:1] or "?"
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "\n".join(lines))
    return faults, best


def expected(rows):
    for c, rows in damage(rows).items():
        faults, (cost, audit, text) = cheapest(rows)
        turns = {r[0] for r in rows} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        yield (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some_turns(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for k in range(rng.randrange(1, 4)):
            turn = rng.choice([k, k, 2 * k, None])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi there.", "what", "Yes!", "", " \n", None, "one. ", "é?"])))
    return rows


@pytest.mark.parametrize("block", [1024, 2])
def test_repair_equals_trying_every_audit(spark, block):
    from holdfast.llm.turn_repair import repaired_conversations
    rows = some_turns(block, 40)
    got = repaired_conversations(spark.createDataFrame([(*r, 7, None, 3, "x") for r in rows], TURNS).repartition(3), block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows), key=repr)


def test_blocks_of_a_long_conversation_compose(spark):
    """A long conversation with ties, repeats and null turns gives the same in blocks of 4 and whole."""
    from holdfast.llm.turn_repair import repaired_conversations
    rng = random.Random(9)
    rows = [(c, rng.choice([k, k // 2, None]), rng.choice(["user", "assistant", "user", "system"]), rng.choice(["a.", "b", "c!", "", "d?", f"{k}."])) for c, n in ((1, 300), (2, 41), (3, 5)) for k in range(n)]
    docs = spark.createDataFrame([(*r, 7, None, 3, "x") for r in rows], TURNS)
    whole, parts = (sorted(map(tuple, repaired_conversations(docs, b).collect())) for b in (512, 4))
    assert whole == parts and len(whole) == 3 and len(whole[0][7]) >= 200


def test_repair_of_lost_and_absent_conversations(spark):
    from holdfast.llm.turn_repair import repaired_conversations
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    docs = spark.createDataFrame([(*r, 7, None, 3, "x") for r in gone], TURNS)
    empty = hashlib.sha256().hexdigest()
    for block in (1024, 1):
        assert {tuple(r)[1:] for r in repaired_conversations(docs, block).collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}
        assert repaired_conversations(docs.where("false"), block).count() == 0


# --- filters -------------------------------------------------------------------------------------------------------

def test_filter_audit_equals_loops(spark):
    from holdfast.llm import filter_audit as fa
    rng = random.Random(2)
    texts = [None, "", "a " * 250, "a b c " * 70, "ABC " + "x y z w " * 60, "tag #1", " ".join(f"w{k}" for k in range(220)), " ".join(f"w{k}" for k in range(220)) + " & more", "É" * 3 + " Ab", "x y " * 210]
    rows = [(rng.choice([k, k, k, 5, None]), rng.choice(texts), rng.choice(["s", "t", "", None])) for k in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(5, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, None, s, None, 1, "p", "d", 1, 1) for i, t, s in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        w, t = WORD.findall(t or ""), t or ""
        smaller = any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in rows)
        return {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), smaller)) if x}
    marked = [(i, s or "", fails(i, t)) for i, t, s in rows]
    want, shapley = {}, {}
    for part in {s for _, s, _ in marked}:
        mine = [(i, f) for i, s, f in marked if s == part]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                hit, before = [(i, x) for i, x in mine if f in x], set(order[:k])
                here = [(i, x) for i, x in hit if not x & before]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                want[part, "".join(order), k + 1] = [sum(not x & {*before, f} for _, x in mine), len(here), len(hit) - len(here), sum(x == {f} for _, x in hit), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in fa.filter_audit(docs, marks).collect()}
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert fa.filter_audit(docs.where("false"), marks).count() == 0
    clean = fa.filter_audit(docs.where("text LIKE 'w0 %' AND text NOT LIKE '%&%' AND doc_id IS NULL"), marks.where("false")).collect()
    assert clean and all(r["removed"] == 0 and r["kept"] > 0 for r in clean if r["filter_order"] == "ABCDE")


def test_long_texts_are_split_in_pieces(monkeypatch):
    from holdfast.llm import filter_audit as fa
    text = ("é b\tc dd\n" * 50 + "z" * 100 + " ").encode() * 3
    whole = fa._words(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(fa, "PIECE", piece)
        assert fa._words(text) == whole == (len(text.split()), len(set(text.split())))
