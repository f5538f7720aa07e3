"""The ten operators against libraries and brute force, with odd inputs."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from fieldloom.llm import components as comp
from fieldloom.llm import language_id, lm_score, mixing, near_dedup, piece_model, radix_dedup, registry, sharding, token_counts, token_file, vector_topk
from fieldloom.session import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "na " * 40_000 + "x" * 5000
BASE = " ".join(f"word{i % 97} item{i}" for i in range(60))
TEXTS = [
    None, "", "   ", "Hello world", "Hello world", "hello  world\n\nnext\tline ", "naïve café — déjà vu", "日本語のテキスト 123", "a\x1fb\x85c", "x" * 64, "x" * 64 + "y", "x" * 64,
    "It's we'll <|endoftext|> end", LONG, LONG, BASE, BASE + " tail", BASE.replace("item7 ", "other "), "12345 678,90 !!!", "ÉCOLE İstanbul ΣΑΣ", "one two", "ONE two", "\u0000 nul \U0001f600",
]


def rows():
    out = [(i * 3 - 5, t, [None, "en", "de"][i % 3], [None, "a", "b", "B"][i % 4], len(t or "")) for i, t in enumerate(TEXTS)]
    return [*out, out[3], (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    # a column name that operators use inside
    return spark.createDataFrame([(*r, "extra") for r in rows()], SCHEMA + ", size string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_bit_packing_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 5, 8, 13, 16, 17, 32):
        ids = rng.integers(0, 2**bits, 1000).astype(np.uint32)
        data = token_file.pack(ids, bits)
        assert len(data) == -(-1000 * bits // 8)
        assert (token_file.unpack(data, bits, 1000) == ids).all()
    assert token_file.bits_for(50_257) == 16 and token_file.bits_for(1) == 1


def test_shard_file_random_access(tmp_path):
    uri = f"file://{tmp_path}/one"
    writer = token_file.ShardWriter(uri, 17, block_tokens=8)
    docs = [np.arange(n, dtype=np.uint32) + n for n in (0, 3, 21, 1, 8)]
    for i, ids in enumerate(docs):
        writer.add(None if i == 1 else i, ids)
    writer.close()
    reader = token_file.ShardReader(uri)
    assert [d for d, _, _ in reader.documents(2)] == [0, None, 2, 3, 4]
    assert all((reader.document(i) == ids).all() for i, ids in enumerate(docs))
    assert (reader.tokens(5, 30) == np.concatenate(docs)[5:30]).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path(registry.BYTE_BPE))
    for shard_size in (4, 1000):
        out = Workspace(spark, "t").path("shards")
        manifest = token_file.write_token_shards(docs, f"file://{out}", P.path(registry.BYTE_BPE), 50_257, 2, docs_per_shard=shard_size)
        got = token_file.read_token_shards(spark, manifest).collect()
        assert len(got) == len(rows())
        want = {}
        for i, t, *_ in rows():
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want[i] = (len(ids), zlib.crc32(ids.tobytes()))
        assert all((r.n_tokens, r.ids_crc32) == want[r.doc_id] for r in got)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda x: -math.inf if x is None else x)
    manifest = token_file.write_token_shards(empty, f"file://{out}2", P.path(registry.BYTE_BPE), 50_257, 2)
    assert token_file.read_token_shards(spark, manifest).count() == 0
    with pytest.raises(TypeError):
        token_file.write_token_shards(odd_named(spark), f"file://{out}3", P.path(registry.BYTE_BPE), 50_257, 2)


def test_token_encoder_equals_library():
    import random

    from tokenizers import Tokenizer

    path = P.path(registry.BYTE_BPE)
    lib, encoder = Tokenizer.from_file(path), token_file.ByteLevelEncoder(path)
    rnd = random.Random(16)
    alphabet = ["a", "B", "é", "日", "١", "7", "'s", "'", "-", "…", "—", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u200b", "\u0301", "😀", "Ġ", "<|endoftext|>", "\x1c", "\x85", "the", "ing"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(4000)]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in range(start, start + 64)) for start in range(0, 0x3000, 64)]
    assert encoder.encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_radix_dedup(docs, empty):
    got = radix_dedup.radix_groups(docs, first_digit=2, growth=2).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows():
        groups[t or ""].append(i)
    assert len(got) == len(rows())
    for t, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    assert radix_dedup.radix_groups(empty).count() == 0
    kept = radix_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_piece_codec(docs, empty):
    import tiktoken

    path = P.path(registry.RANKS)
    ranks = {t: i for i, t in enumerate(piece_model.read_ranks(path))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t, *_ in rows():
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = piece_model.bpe_round_trip(docs, path, P.PATTERN)
    assert by_row(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert piece_model.bpe_round_trip(empty, path, P.PATTERN).count() == 0
    back = piece_model.bpe_decode(piece_model.bpe_encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())


def test_piece_codec_on_every_character():
    path = P.path(registry.RANKS)
    codec = piece_model.PieceCodec(path, P.PATTERN)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(codec.rank), special_tokens={})
    for start in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}1" for c in range(start, start + 64))
        assert codec.encode([text])[0] == enc.encode_ordinary(text)
        assert codec.decode(codec.encode([text])[0]) == text.encode()


def brute_lm(table, is_held):
    """(score, base score) of each row, from exact counts that are rounded as the filter's levels are."""
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in table:
        if not is_held(i):
            w = [b"", *tok(t)]
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    least = lm_score.thresholds().tolist()

    def rounded(c):
        k = sum(x <= c for x in least)
        return (least[k - 1] + least[k] - 1) / 2 if k else 0.0

    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for _, t in table:
        w = [b"", *tok(t)]
        score = 0.0
        for k in range(1, len(w)):
            pair = rounded(two[w[k - 1], w[k]])
            p = p1(w[k])
            if one[w[k - 1]]:
                p = (1 - lm_score.PAIR) * p + lm_score.PAIR * pair / max(one[w[k - 1]], pair)
            if k > 1:
                seen = rounded(three[w[k - 2], w[k - 1], w[k]])
                p = (seen + lm_score.TRIPLE * p) / (max(rounded(two[w[k - 2], w[k - 1]]), seen) + lm_score.TRIPLE)
            score += math.log10(p)
        out.append((score, sum(math.log10(p1(x)) for x in w[1:])))
    return out


def test_lm_score(docs, empty):
    held = language_id.holdout("doc_id", 3) == 0
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0
    c = collections.Counter(w for i, t, *_ in rows() if not is_held(i) for w in tok(t))
    n = sum(c.values())
    table = [(i, t) for i, t, *_ in rows()]
    want = sorted(((i is not None, i or 0, is_held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n), s) for (i, t), s in zip(table, brute_lm(table, is_held), strict=True))
    # a filter of many bits errs in no n-gram here; blocks and ranges of any size give the same
    for block_bytes, entries in ((3000, 2000), (10**7, 10**6)):
        got = lm_score.score_documents(docs, held, block_bytes=block_bytes, range_entries=entries, bits_per_entry=64.0).collect()
        got = sorted(((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens), (r.score, r.base_score)) for r in got)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == [pytest.approx(w[1], rel=1e-6) for w in want]
    assert lm_score.score_documents(empty, held).count() == 0
    odd = odd_named(docs.sparkSession)
    assert sorted(str(r.doc_id) for r in lm_score.score_documents(odd, language_id.holdout("doc_id", 3) == 0).collect()) == ["None", "id-1", "id-2", "id-3", "id-3"]


def test_lm_probabilities_sum_to_one():
    """Over all words and one unseen word, in any context, as long as counts are exact."""
    texts = [["a", "b", "a", "c"], ["a", "b", "b"], ["c"]]
    seqs = [["", *t, ""] for t in texts]
    vocab = sorted({w for s in seqs for w in s[1:]})
    one = collections.Counter(w for s in seqs for w in s[1:])
    two = collections.Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
    three = collections.Counter(p for s in seqs for p in zip(s, s[1:], s[2:], strict=False))
    floor = sum(one.values()) + lm_score.ADD * (len(vocab) + 1)
    words = [*vocab, "unseen"]
    pairs, triples = sorted(two), sorted(three)
    gram = np.array([*(two[p] for p in pairs), *(three[p] for p in triples), 0], float)
    word = np.array([one[w] for w in words], float)
    for u, v in [*pairs, ("b", "c"), ("unseen", "a"), ("a", "unseen")]:
        if v == "":
            continue
        total = 0.0
        for w in words:
            at = lambda table, base, key: base + table.index(key) if key in table else len(gram) - 1
            pair = np.array([at(pairs, 0, (u, v)), at(pairs, 0, (v, w))])
            triple = np.array([-1, at(triples, len(pairs), (u, v, w))])
            p = lm_score.smoothed(word, gram, np.array([words.index(v), words.index(w)]), np.array([words.index(u), words.index(v)]), pair, triple, floor)
            total += p[1]
        assert total == pytest.approx(1.0)


def test_lm_scores_known_passages_higher(spark):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rnd.choices(words, k=60))
    table = [(i, " ".join(rnd.choices(words, k=80)) + " " + passage) for i in range(40)] + [(100, passage), (101, " ".join(rnd.choices(words, k=60)))]
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(table, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100].score > got[100].base_score + 40
    assert got[101].score > got[101].base_score - 10


def test_lm_credits_a_passage_of_one_training_text(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    once = " ".join(rnd.choices(words, k=64))
    table = [(i, " ".join(rnd.choices(words, k=400))) for i in range(40)] + [(40, once), (100, once), (101, " ".join(rnd.choices(words, k=64)))]
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(table, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100].score > got[100].base_score + 20
    assert got[101].score < got[101].base_score + 5


def test_log_frequency_filter():
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 1000, 5000)
    level = lm_score.levels(counts)
    assert lm_score.levels(np.array([0, 1, 2, 5, 6, 7])).tolist() == [0, 1, 2, 5, 5, 6]
    m = lm_score.bits_of(level)
    bits = lm_score.build(keys, level, m)
    found = lm_score.probe(bits, m, keys)
    assert (found >= level).all() and (found > level).mean() < 0.05
    assert (lm_score.probe(bits, m, rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.05
    near = np.abs(lm_score.level_counts()[level] / counts - 1)
    assert near.max() < 0.25
    k, n = lm_score.expand(lm_score.squeeze(np.unique(keys), np.arange(1, 5001)))
    assert (k == np.unique(keys)).all() and (n == np.arange(1, 5001)).all()


def mix_brute(table, weights, share, most):
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    total = collections.Counter()
    for _, t, _, s, _ in table:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, free = share * sum(total.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * total[s]}
        if not over:
            break
        for s in over:
            target[s] = most * total[s]
            left -= target[s]
        free -= over
    return total, target | {s: level * weight[s] for s in free}


def test_mix(docs, empty):
    total, target = mix_brute(rows(), [3, 1, 2], 1.5, 2.0)
    got = mixing.pareto_mix(docs, **registry.MIX).collect()
    assert len(got) == len(rows())
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max((r.size for r in got if r.source == s), default=0)
    assert by_row(mixing.pareto_mix(docs.repartition(2), **registry.MIX), "doc_id", "source", "size", "taken") == by_row(mixing.pareto_mix(docs, **registry.MIX), "doc_id", "source", "size", "taken")
    assert mixing.pareto_mix(empty, **registry.MIX).count() == 0
    mixed = mixing.mix_documents(docs, **registry.MIX)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def brute_sample(table, seed, share, most, power):
    """One source of weight 1: taken words by document, from the method's definition."""
    import xxhash

    sizes = {i: len(t.split()) for i, t in table}
    total = sum(sizes.values())
    target = min(share, most) * total
    whole = math.floor(target / total)
    part = target - whole * total
    p, mean = part / total, total / len(table)
    ranks = []
    for i, t in table:
        text_hash = xxhash.xxh64_intdigest(t.encode(), 42)
        text_hash -= 2**64 if text_hash >= 2**63 else 0
        u = (int(hashlib.md5(f"{seed}|{i}|{text_hash}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        ranks.append((u / (1 - u) / (p / (1 - p) * (mean / sizes[i]) ** power), i))
    ranks.sort()
    best, upto, cut = part, 0, 0
    for k, (_, i) in enumerate(ranks, 1):
        upto += sizes[i]
        if abs(part - upto) < best:
            best, cut = abs(part - upto), k
    chosen = {i for _, i in ranks[:cut]}
    gap = part - sum(sizes[i] for i in chosen)
    moves = [(abs(gap + (sizes[i] if i in chosen else -sizes[i])), r, i) for r, i in ranks]
    moves = [m for m in moves if m[0] < abs(gap)]
    if moves:
        chosen ^= {min(moves)[2]}
    return {i: sizes[i] * (whole + (i in chosen)) for i in sizes}


@pytest.mark.parametrize("share", [0.3, 0.999, 1.5])
def test_mix_equals_brute_force_sample(spark, share):
    import random

    rnd = random.Random(13)
    table = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([3, 20, 150])))) for i in range(400)]
    df = spark.createDataFrame([(*r, "s") for r in table], "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r.taken for r in mixing.pareto_mix(df, [1], share, length_power=0.5).collect()}
    assert got == brute_sample(table, "mix", share, 2.0, 0.5)


def test_many_sources(spark):
    table = [(i, "w " * (1 + i % 7), None if i % 97 == 0 else f"s{i % 211}") for i in range(3000)]
    total, target = mix_brute([(i, t, None, s, 0) for i, t, s in table], [3, 1, 2], 1.5, 2.0)
    got = mixing.pareto_mix(spark.createDataFrame(table, "doc_id long, text string, source string").repartition(5), **registry.MIX).collect()
    assert len(got) == 3000
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])


def test_mix_tilt_prefers_likely_documents(spark):
    table = [(i, "a b c", "s", 9.0 if i % 2 else 1.0) for i in range(2000)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string, odds double")
    got = mixing.pareto_mix(df, [1], 0.5, tilt_col="odds").collect()
    taken = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert abs(sum(taken) - 3000) <= 3 and taken[1] > 2 * taken[0]


def check_shards(got, table, n_shards):
    """Sizes, checksums and slots as defined; returns the bytes of each shard."""
    text = dict(table)
    size = collections.Counter({k: 0 for k in range(n_shards)})
    slots = collections.defaultdict(list)
    for r in got:
        value = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(value) + 1, zlib.crc32(value))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(table) and set(size) == set(range(n_shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def test_shards(spark, docs, empty):
    got = sharding.shard_documents(docs, 4, part_rows=3).collect()
    assert len(got) == len(rows())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(empty, 4).count() == 0
    assert {r.shard for r in sharding.shard_documents(docs, 1).collect()} == {0}
    odd = odd_named(spark)
    assert sharding.shard_documents(odd, 3).count() == 5


@pytest.mark.parametrize("part_rows", [100, 1 << 20])
def test_shards_keep_groups_and_are_even(spark, part_rows):
    import random

    rnd = random.Random(14)
    table = [(i, f"text {i} " * rnd.randrange(1, 40)) for i in range(3000)]
    for g in range(300):
        table += [(len(table) + k, f"group {g} of equal texts " * 3) for k in range(rnd.randrange(2, 30))]
    table += [(len(table) + k, "same and same again") for k in range(300)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    got = sharding.shard_documents(df, 8, part_rows=part_rows).collect()
    size = check_shards(got, table, 8)
    where = collections.defaultdict(set)
    text = dict(table)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    mean = sum(size.values()) / 8
    assert all(abs(x / mean - 1) < 0.006 for x in size.values())
    again = sharding.shard_documents(df.repartition(3), 8).collect()
    assert {(r.doc_id, r.shard) for r in got} == {(r.doc_id, r.shard) for r in again}


@pytest.mark.parametrize("ids", ["own", "none"])
def test_a_group_above_a_shard_is_spread(spark, ids):
    table = [(i, f"text {i} " * 5) for i in range(1500)] + [(5000 + i if ids == "own" else None, "copy " * 10) for i in range(1500)]
    got = sharding.shard_documents(spark.createDataFrame(table, "doc_id long, text string").repartition(4), 8, part_rows=100).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    assert len(got) == 3000 and all(abs(x / mean - 1) < 0.05 for x in size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_splitters_meet_their_goals(spark):
    rng = np.random.default_rng(15)
    keys = np.sort(rng.integers(0, 2**62, 4000))
    sizes = rng.integers(1, 100, 4000)
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)], "key long, size long")
    goals = [sizes.sum() * k / 7 for k in range(1, 7)]
    cuts = sharding.find_splitters(df, goals, 60, probes=8)
    assert [abs(sizes[keys < c].sum() - g) <= 60 for c, g in zip(cuts, goals, strict=True)] == [True] * 6
    assert sharding.fill([5, 0, 1], 6) == [pytest.approx(0), pytest.approx(3.5), pytest.approx(2.5)]


def brute_classes(table, least=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = [shingles(t) for _, t in table], list(range(len(table)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(table)):
        for b in range(a):
            same = (table[a][1] or "") == (table[b][1] or "")
            if same or (sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
    return [root(x) for x in range(len(table))]


def near_table():
    import random

    rnd = random.Random(5)
    out = []
    for family in range(12):
        base = [f"f{family}w{rnd.randrange(400)}" for _ in range(150)]
        for _ in range(rnd.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rnd.randrange(8)):
                words[rnd.randrange(150)] = f"edit{rnd.randrange(10**6)}"
            out.append((len(out), " ".join(words)))
            if rnd.random() < 0.3:
                base = words  # chains of versions
    return [*out, *((1000 + k, t) for k, t in enumerate([None, "", "a b", "A b", "a b c", None]))]


@pytest.mark.parametrize("block", [8, 192])
def test_near_classes(spark, block):
    table = near_table()
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in near_dedup.near_classes(df, block=block).collect()}
    want = brute_classes(table)
    least = {c: min(table[i][0] for i in range(len(table)) if want[i] == c) for c in set(want)}
    assert {i: least[c] for (i, _), c in zip(table, want, strict=True)} == {i: r.class_id for i, r in got.items()}
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == want.count(want[[t[0] for t in table].index(r.doc_id)]) for r in got.values())


def test_near_recall_on_repeated_passages(spark):
    """Pairs of set similarity just above 0.8, one of each repeating a fifth of its shingles 200 times."""
    table = []
    for pair in range(150):
        words = [f"p{pair}w{k}" for k in range(94)]
        changed = [*words[:-5], *(f"q{pair}w{k}" for k in range(5))]
        table += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join([*changed, *([" ".join(words[:20])] * 200)]))]
    want = brute_classes(table)
    linked = sum(want[2 * k] == want[2 * k + 1] for k in range(150))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(150) if want[2 * k] == want[2 * k + 1])
    assert linked == 150 and found >= 0.97 * linked


ODD_NAMES = "`a.b` string, `__copies` long, `__mix_id` long, `__stay_id` string, `row_id` long, `c0` string, doc_id string, text string, source string, lang string"


def odd_named(spark):
    table = [("x", 1, 2, "s", 7, "c", i, t, s, "en") for i, t, s in (("id-1", "one two three", "a"), ("id-2", "one two three", "a"), (None, "four five", None), ("id-3", None, "b"), ("id-3", "", "b"))]
    return spark.createDataFrame(table, ODD_NAMES)


def test_any_column_names_and_string_ids(spark):
    odd = odd_named(spark)
    for f in (radix_dedup.exact_dedup, near_dedup.near_dedup):
        kept = f(odd)
        assert kept.columns == odd.columns and sorted((r.text or "") for r in kept.collect()) == ["", "four five", "one two three"]
    mixed = mixing.mix_documents(odd, **registry.MIX)
    assert mixed.columns == odd.columns
    assert {r.keep_id for r in radix_dedup.radix_groups(odd).collect()} == {"id-2", None, "id-3"}
    assert {r.class_id for r in near_dedup.near_classes(odd).collect()} == {"id-1", None, "id-3"}
    path = P.path(registry.PIECES)
    model = language_id.fit_language_model(odd, path)
    assert language_id.accept_known_language(odd, model, path).columns == odd.columns
    assert {r.doc_id for r in language_id.predict_language(odd, model, path).collect()} == {"id-1", "id-2", "id-3", None}
    assert {r.doc_id for r in token_counts.token_counts(odd, P.path(registry.WORD_BPE), 5).collect()} == {"id-1", "id-2", "id-3", None}
    assert {r.doc_id for r in piece_model.bpe_round_trip(odd, P.path(registry.RANKS), P.PATTERN).collect()} == {"id-1", "id-2", "id-3", None}
    assert piece_model.bpe_encode(odd, P.path(registry.RANKS), P.PATTERN).columns == [*odd.columns, "token_ids"]


def test_near_odd_rows(docs, empty):
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(rows())
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert near_dedup.near_classes(empty).count() == 0


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = elements[:220], elements[80:]
    wa, wb = rng.uniform(0.5, 3, 220), rng.uniform(0.5, 3, 220)
    sig = near_dedup.prob_min_hash([a, b, a[:1], np.empty(0, np.uint64)], [wa, wb, wa[:1], np.empty(0)], 4096)
    pa, pb = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    every = set(pa) | set(pb)
    exact = sum(1 / sum(max(pa.get(e, 0) / pa[d], pb.get(e, 0) / pb[d]) for e in every) for d in set(pa) & set(pb))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    assert (sig[2] == a[0]).all()


def test_components(spark):
    import random

    rnd = random.Random(6)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    edges = chain + star + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, comp.components(df, Workspace(spark, "t"), "c").collect()))
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert comp.components(df.where("a < 0"), Workspace(spark, "t"), "c").count() == 0


def test_language_id(spark, docs, empty):
    path = P.path(registry.PIECES)
    table = []
    words = {"en": "the house is very large and they have water over there with some bread", "de": "das haus ist sehr gross und wir haben wasser dort mit etwas brot", "fr": "la maison est très grande et nous avons de l'eau là avec du pain"}
    for lang, text in words.items():
        parts = text.split()
        table += [(len(table) + k, " ".join(parts[k % 5 :] + parts[: k % 7]), lang) for k in range(20)]
    train = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train, path)
    test = spark.createDataFrame([(1, "They have bread!"), (2, "Wir haben Brot"), (3, "NOUS AVONS"), (4, None), (5, "123 — …"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(test, model, path).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    odd = language_id.predict_language(docs, model, path).collect()
    assert len(odd) == len(rows())
    kept = language_id.accept_known_language(docs, model, path)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in odd)
    assert language_id.predict_language(empty, model, path).count() == 0
    none = language_id.fit_language_model(empty, path)
    assert {r.lang_pred for r in language_id.predict_language(test, none, path).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(P.path(registry.PIECES))
    rng = np.random.default_rng(7)
    probs = rng.uniform(0.01, 0.2, (pieces.size, 2))

    def total(word):
        if not word:
            return np.ones(2)
        return sum(probs[pieces.ids[word[:k]]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces.ids)

    words = [b" the", b" abc", " ét".encode()]
    alpha = language_id.forward(pieces.edges(words), 4, 3, probs)[4]
    beta = language_id.backward(pieces.edges(words), 4, 3, probs)[0]
    for k, w in enumerate(words):
        assert alpha[k] == pytest.approx(total(w)) and beta[k] == pytest.approx(total(w))


def decimal_log(pieces, probs, word):
    """Natural logarithm of the sum over all segmentations, in 60 digits."""
    import decimal

    with decimal.localcontext(decimal.Context(prec=60)):
        alpha = [decimal.Decimal(1)] + [decimal.Decimal(0)] * len(word)
        for stop in range(1, len(word) + 1):
            for start in range(stop):
                if word[start:stop] in pieces.ids:
                    alpha[stop] += alpha[start] * decimal.Decimal(float(probs[pieces.ids[word[start:stop]]]))
        return float(alpha[-1].ln())


def test_language_scores_of_long_words():
    pieces = language_id.Pieces(P.path(registry.PIECES))
    rng = np.random.default_rng(9)
    log_probs = rng.uniform(-20, -8, (pieces.size, 2))
    scorer = language_id.Scorer(pieces, log_probs)
    words = ["cat", "donaudampfschifffahrtsgesellschaft" * 6, "これは日本語の文章です" * 8, "x" * 300, "straße"]
    got = scorer.score_words([w.encode() for w in words])
    for k, w in enumerate(words):
        for lang in (0, 1):
            assert got[k][lang] == pytest.approx(decimal_log(pieces, np.exp(log_probs[:, lang]), b" " + w.encode()), rel=1e-9)
    # one pass in logarithms, one in plain numbers
    for w in (b" cat", " straße".encode()):
        assert language_id.log_forward(pieces, w, log_probs) == pytest.approx(scorer.score_words([w[1:]])[0])
    ids, share = language_id.log_expectations(pieces, b" cat", log_probs[:, 0])
    assert sum(len(t) * s for t, s in ((next(t for t, k in pieces.ids.items() if k == i), s) for i, s in zip(ids, share, strict=True))) == pytest.approx(4)


def test_language_words_are_letter_runs():
    assert [w.decode() for t in language_id.tokens_of("“Hello”… ١٢ l’été नमस्ते x2y") for w in language_id.words_in(t)] == ["hello", "l", "été", "नमस्ते", "x", "y"]
    assert [x for t in language_id.tokens_of("— ١٢ …") for x in language_id.words_in(t)] == []


def test_language_predictions_equal_brute_force(spark):
    path = P.path(registry.PIECES)
    rng = np.random.default_rng(10)
    pieces = language_id.Pieces(path)
    model = {"langs": ["a", "b", "c"], "log_probs": rng.uniform(-14, -6, (pieces.size, 3)).astype(np.float32).astype(float), "log_prior": np.log([0.5, 0.3, 0.2])}
    texts = ["the cat", "über den Wolken", "日本語日本語日本語" * 9, "Pneumonoultramicroscopicsilicovolcanoconiosis " * 3, "a", None, "1 2", "z" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, `the.text` string")
    got = {r.doc_id: r for r in language_id.predict_language(df, model, path, "id", "the.text").collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = model["log_prior"] + [sum(decimal_log(pieces, np.exp(model["log_probs"][:, k]), b" " + w.encode()) for w in words) for k in range(3)]
        share = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert got[i].lang_pred == "abc"[int(x.argmax())] and got[i].score == pytest.approx(share.max(), rel=1e-6)


def test_unlearned_scripts_go_and_short_shared_words_stay(spark):
    path = P.path(registry.PIECES)
    table = [(k, "no la casa el agua " * 20, "es") for k in range(20)] + [(100 + k, "no the house of water " * 20, "en") for k in range(20)]
    model = language_id.fit_language_model(spark.createDataFrame(table, "doc_id long, text string, lang string"), path)
    test = spark.createDataFrame([(1, "no"), (2, "日本語の文章です。" * 30), (3, "the house"), (4, None), (5, "12")], "doc_id long, text string")
    assert {r.doc_id for r in language_id.accept_known_language(test, model, path).collect()} == {1, 3}


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path(registry.WORD_BPE)
    lib = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in rows():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert by_row(token_counts.token_counts(docs, path, 2048), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, path, 2048).count() == 0


def test_token_counts_on_every_character():
    from tokenizers import Tokenizer

    path = P.path(registry.WORD_BPE)
    counter, lib = token_counts.WordCounter(path), Tokenizer.from_file(path)
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in range(start, start + 64)) for start in range(0, 0x3000, 64)]
    assert counter.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert len(counter.whole) > 30_000


def brute_topk(table, k=20, every=20):
    whole = [(i, [math.floor(64 * x) if abs(x) < 2**40 else 64 * int(x) for x in v]) for i, v in table if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = {}
    for i, v in whole:
        if i % every == 0:
            own[i] = min(own.get(i, v), v)
    out = set()
    for q, mine in own.items():
        scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in whole if i != q and len(v) == len(mine))[:k]
        out |= {(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize(("stripe", "block"), [(3, 40), (4096, 16384)])
def test_topk(spark, stripe, block):
    rng = np.random.default_rng(8)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    table += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (320, [0.0] * 8), (None, [1.0] * 8), (7, table[7][1]), (20, table[20][1]), (340, [2.0] * 5)]
    table += [(360, []), (361, []), (363, []), (380, [1.0, 2.0]), (400, [3.0] * 5), (401, [-1.0] * 5)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(3)
    from pyspark.sql import functions as F

    vectors = df.select("vec_id", vector_topk.quantise("embedding").alias("values"))
    got = vector_topk.exact_topk(vectors, vectors.where("vec_id % 20 = 0"), 20, stripe=stripe, block=block).collect()
    assert {tuple(r) for r in got} == brute_topk(table) and len(got) == len(brute_topk(table))
    assert vector_topk.exact_topk(vectors.where(F.lit(False)), vectors, 20).count() == 0
    assert vector_topk.exact_topk(vectors, vectors.where(F.lit(False)), 20).count() == 0
    with pytest.raises(TypeError):
        vector_topk.exact_topk(vectors.withColumn("vec_id", F.lit("a")), vectors, 20)


def test_topk_of_huge_components_is_exact(spark):
    table = [(0, [3e9, -1.0, 2.0]), (1, [1e10, 5.0, 1.0]), (2, [2.5e17, 1.0, 0.5]), (3, [2.5e17, 1.0, 0.5]), (4, [-3e30, 0.0, 0.0]), (5, [3e30, 1.0, 7.0]), (6, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0]), (40, [-1e30, 3.0, 0.25]), (60, [1e300, 1.0, 1.0]), (7, [1.7e308, 0.0, 0.0])]
    df = spark.createDataFrame(table, "vec_id int, embedding array<double>")
    vectors = df.select("vec_id", vector_topk.quantise("embedding").alias("values"))
    got = {tuple(r) for r in vector_topk.exact_topk(vectors, vectors.where("vec_id % 20 = 0"), 3).collect()}
    # 64 x 1.7e308 is not finite, so that vector takes no part
    assert got == brute_topk([r for r in table if r[0] != 7], 3)


def test_topk_of_integers(spark):
    big = 2**62 + 12345
    table = [(0, [big, 1]), (1, [big, 3]), (2, [big - 1, 3]), (3, [-big, 9])]
    vectors = spark.createDataFrame(table, "vec_id long, values array<long>")
    got = [r.vec_id for r in sorted(vector_topk.exact_topk(vectors, vectors.where("vec_id = 0"), 4).collect(), key=lambda r: r["rank"])]
    assert got == [1, 2, 3]


def test_rank_file_reading(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate([b"a", b"b", b"ab"])))
    assert piece_model.read_ranks(str(path)) == [b"a", b"b", b"ab"]
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        piece_model.read_ranks(str(path))
