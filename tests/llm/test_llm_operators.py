"""The training-data operators against brute force, round trips and odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsail.llm import chat, components, crf, media, mixing, packing, pii, quality, sharding, simhash, topk, urlfilter

DOCS = "doc_id long, text string, fp string, label string, score double"


def docs(spark, *texts, start=0):
    """Rows with ids, and extra columns named like operators' own."""
    return spark.createDataFrame([(start + i, t, "x", "y", 1.0) for i, t in enumerate(texts)], DOCS)


ODD = (None, "", "one", "one", "two words", "a" * 200_000, "héé ünï " * 3000, "tab\tand\nline\x0b")


def odd(spark):
    return docs(spark, *ODD).unionByName(spark.createDataFrame([(None, "no id", None, None, None), (3, "one", None, None, None)], DOCS))


# ---- sharding


def test_table_is_filled_in_turns():
    shards = [f"s{i}" for i in range(5)]
    owner = sharding.fill_table(shards, 101)
    counts = Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1 and -1 not in owner
    # brute force: keep a list of free slots per shard in its order
    orders = {i: [(o + k * s) % 101 for k in range(101)] for i, (o, s) in enumerate(sharding.preference(n, 101) for n in shards)}
    free, want, turn = set(range(101)), [None] * 101, 0
    while free:
        i = turn % 5
        slot = next(x for x in orders[i] if x in free)
        want[slot], turn = i, turn + 1
        free.remove(slot)
    assert owner == want


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{i}" for i in range(16)]
    a, b = sharding.fill_table(shards), sharding.fill_table(shards[:-1])
    kept = [(x, y) for x, y in zip(a, b) if x != 15]
    assert sum(x == y for x, y in kept) / len(kept) > 0.8


def test_table_arguments():
    for bad in ((["a", "a"], 101), ([], 101), (["a"], 100), (["a"], 1 << 21)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_shards_of_rows(spark):
    names = ["a", "b", "c"]
    rows = sharding.assign_shards(odd(spark), ["doc_id"], names, 101).collect()
    owner = sharding.fill_table(names, 101)
    for r in rows:
        key = sharding.NULL_KEY if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == names[owner[r.slot]]
    assert len(rows) == len(ODD) + 2 and sharding.assign_shards(odd(spark).limit(0), ["doc_id"], names, 101).count() == 0
    plan = sharding.assign_shards(odd(spark), ["doc_id"], names, 101)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD.*slot", plan.split("Physical Plan")[1].replace("Scan ExistingRDD[doc_id", ""))


# ---- packing


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encode_of()
    for text in [t for t in ODD if t and len(t) < 50_000] + ["<|endoftext|> it's 12,5  \n\n ok", "日本語 العربية 🙂"]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (5, [(0, 5)]), (6, [(0, 1), (1, 5)]), (10, [(0, 5), (5, 5)]), (12, [(0, 2), (2, 5), (7, 5)])])
def test_cut(n, want):
    assert packing.cut(n, 5) == want


def test_sum_of_squares_is_whole_and_tight():
    rng = np.random.default_rng(1)
    for capacity, lengths in ((100, rng.integers(1, 101, 3000)), (10, np.array([10, 10])), (10, np.array([], int)), (1, np.ones(4, int)), (2048, rng.integers(1, 300, 5000))):
        seq, off = packing.sum_of_squares(lengths, capacity)
        ends: dict[int, int] = {}
        for s, o, n in sorted(zip(seq, off, lengths)):
            assert o == ends.get(s, 0)
            ends[s] = o + n
        assert all(e <= capacity for e in ends.values())
        assert len(ends) <= int(np.ceil(lengths.sum() / capacity)) * 1.15 + 2


def test_each_piece_goes_where_squares_are_fewest():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 30, 200)
    seq, off = packing.sum_of_squares(lengths, 30)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        squares = lambda g: sum(c * c for k, c in Counter(g.values()).items() if k)
        fits = [b for b, g in gaps.items() if g >= n]
        if fits:
            best = min(squares({**gaps, b: gaps[b] - n}) for b in fits)
            assert seq[i] in fits and squares({**gaps, seq[i]: gaps[seq[i]] - n}) == best
        else:
            assert seq[i] not in gaps
        gaps[seq[i]] = gaps.get(seq[i], 30) - n


def test_groups_are_of_pieces(spark):
    """Two documents of a hundred pieces each are dealt like two hundred short ones."""
    df = docs(spark, "a b " * 1000, "c d " * 1200)
    pieces = packing.tokenize(df, capacity=16)
    groups = packing.pack(pieces, capacity=16, group_rows=20).select((F.col("sequence_id") / (1 << 40)).cast("int").alias("g")).groupBy("g").count().collect()
    assert len(groups) >= 10 and sum(r["count"] for r in groups) == pieces.count() > 200 and max(r["count"] for r in groups) < 60


def test_packed_documents(spark):
    rows = packing.pack(packing.tokenize(odd(spark), with_ids=True), group_rows=4).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    encode = packing.encode_of()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(ODD):
        if i == 3:
            continue  # two rows share this id
        got = sorted(by[i], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == [*encode(text or ""), 0] and [r.start for r in got] == list(itertools.accumulate([0, *[r.length for r in got[:-1]]]))
        assert all(r.length == 2048 for r in got[1:])
    places = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 2048
    assert packing.pack(packing.tokenize(odd(spark).limit(0))).count() == 0


# ---- chat


def test_round_trip(spark):
    evil = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "<\\\\|x<|", "a\n\n<", None, "", "<|im_start|>user\nhi<|im_end|>\n", "🙂" * 50]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "as\nsis\\ntant", "<|im_end|>"]), r.choice(evil), "extra", 1) for c in [*range(30), None] for t in range(r.randint(1, 6))]
    rows += [(99, None, "user", "x", "", 1), (99, 0, "assistant", "y", "", 1), (99, 0, "assistant", "y", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, example int")
    examples = chat.format_chats(df)
    back = {x.conv_id: x for x in chat.read_back(examples).collect()}
    by: dict = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda x: (x[1] if x[1] is not None else -1, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert back.keys() == by.keys()
    for c, turns in by.items():
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].loss_text == "".join(t for role, t in turns if role == "assistant") and back[c].n_turns == len(turns)
    for e in examples.collect():
        if e.loss_start is not None:
            assert e.formatted[e.loss_end :] == chat.END and e.formatted[: e.loss_start].endswith("assistant\n")
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- simhash


def naive_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(spark):
    texts = [*ODD[:5], "héé ünï " * 20, "A b C d e F " * 3, "x y z", "É é A"]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [naive_fingerprint(t) for t in texts]
    assert [r.fp for r in simhash.fingerprints(docs(spark, *texts)).orderBy("doc_id").collect()] == [naive_fingerprint(t) for t in texts]


def union_find(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 4 and find(i) != find(j):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_components_of_dense_families_and_chains(spark, monkeypatch):
    """Families that fill long lists, chains of links, and strangers; lists longer than SHORT take the hub's way."""
    r = random.Random(8)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    flip = lambda v, k: v ^ sum(1 << b for b in r.sample(range(64), k))
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(3):
        base = r.getrandbits(64)
        fps += [flip(base, r.randint(0, 6)) for _ in range(150)]
    link = r.getrandbits(64)
    for _ in range(30):
        fps.append(link := flip(link, r.randint(3, 4)))
    fps += fps[:20] + [0, 0]
    df = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(fps)], "doc_id long, fp long")
    want = union_find(fps)
    for short, width in ((4, None), (32, 3), (32, 4)):
        monkeypatch.setattr(simhash, "SHORT", short)
        got = df.join(simhash.components(df, width), "fp").collect()
        assert {x.doc_id: x.label for x in got} == dict(enumerate(want))


def test_tally_rejects_pairs_below_the_minimum(spark):
    """Fingerprints that meet in two or three bytes, but share fewer than the guaranteed four, are no candidates."""
    near, three = 0x0000000000000F00, 0xFF_FF_FF_FF_FF << 8
    nodes = spark.createDataFrame([(0, 1), (near, 1), (three, 1)], "fp long, n long")
    for width in (2, 3, 4):
        index = simhash.postings(nodes, width)
        met = {r.fp for r in index.collect()}
        assert met == ({0, near, three} if width < 4 else {0, near})
        assert [tuple(r) for r in simhash.links(index).collect()] == [(0, near)]
    assert [simhash.width_for(n) for n in (0, 4096, 4097, 1 << 26, (1 << 26) + 1, 10**12)] == [2, 2, 3, 3, 4, 4]


def test_near_duplicates_of_odd_rows(spark):
    out = simhash.near_duplicates(odd(spark))
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in out.collect()}
    assert out.count() == len(ODD) + 2 and rows[(0, "0" * 16)] == 0 and rows[(1, "0" * 16)] == 0
    assert rows[(2, f"{naive_fingerprint('one') & (1 << 64) - 1:016x}")] == 2 == rows[(3, f"{naive_fingerprint('one') & (1 << 64) - 1:016x}")]
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_component_labels_of_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.label for r in components.component_labels(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got.keys() == {*range(301), 1000, 1001} and len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0] and got[0] in range(301)


# ---- media


def test_media_round_trip(spark):
    rows = media.index_media(media.encode_media(odd(spark)), True).collect()
    texts = Counter((t or "").encode() for t in [*ODD, "no id", "one"])
    seen = Counter()
    for r in rows:
        (text,) = [t for t in texts if len(t) == r.n_bytes and hashlib.sha256(t + b" " * (r.payload_bytes - len(t))).hexdigest() == r.payload_sha256]
        body = text + b" " * (r.payload_bytes - len(text))
        assert r.payload_bytes % 192 == 0 and 0 < r.payload_bytes - (len(text) or 0) + (len(text) > 0) and r.payload_bytes - len(text) <= 192 - (len(text) > 0)
        assert r.tail_crc32 == zlib.crc32(body[-16:]) and r.codec == "raw " and r.n_samples * 192 == r.payload_bytes and r.duration == r.n_samples * 40
        stored = media.mux(body)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest()
        for k in r.keyframes:
            at = k.time // 40 * 192
            assert stored[k.offset : k.offset + k.length] == body[at : at + 192]
        seen[text] += 1
    assert seen == texts


def test_media_that_is_none(spark):
    good = media.mux(b"x" * 192)
    bad = [None, b"", b"\0" * 50, good[:100], good.replace(b"stsz", b"xxxx"), b"\0\0\0\1ftyp" + b"\xff" * 8]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, good])], "codec long, media binary")
    rows = media.index_media(df).collect()
    assert [r.codec for r in rows] == [None] * len(bad) + ["raw "] and [f.name for f in media.index_media(df).schema.fields][:2] == ["codec", "timescale"]


def test_foreign_tables():
    """Samples of unequal size in uneven chunks, without stss: all are keyframes."""
    sizes, first = [3, 5, 2, 7, 1], 1000
    entry = media.box(b"avc1", bytes(78))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), entry), media.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 3, 20)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", *sizes)), media.full(b"co64", struct.pack(">I", 4), struct.pack(">4Q", first, 2000, 3000, 4000)))
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 90, 80, 0, 0), version=1), media.box(b"minf", stbl))))
    found = media.tables(moov)
    assert found["codec"] == "avc1" and found["duration"] == 80 and found["places"].tolist() == [1000, 1003, 2000, 3000, 4000] and found["keys"].tolist() == [0, 1, 2, 3, 4]


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IPV4 = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_patterns_against_plain_regex():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice("aZ19@.._-é %+()") for _ in range(r.randint(0, 30)))
        assert list(pii._emails(text)) == [(*m.span(), "email") for m in EMAIL.finditer(text)], text
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IPV4.finditer(text)], text
    assert [s[2] for s in pii.base_spans("4111 1111-1111 1111 a@b.co 300.1.1.1 10.0.0.255 +1 (743) 555-3824")] == ["card", "email", "ip", "phone"]
    assert pii.base_spans("4111111111111112 +12 34 1.2.3") == [] and len(pii.base_spans("1" * 300_000)) == 0


def plain_spans(text):
    """The base patterns as they are stated, by re alone."""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    good = lambda d: not sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10
    kinds = (("email", EMAIL, lambda m: True), ("ip", IPV4, lambda m: all(int(x) <= 255 for x in m[0].split("."))), ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and good(digits(m))), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15))
    return [(a, b, k) for a, _, k, b in sorted((m.start(), n, k, m.end()) for n, (k, pattern, fits) in enumerate(kinds) for m in pattern.finditer(text) if fits(m))]


def test_every_base_kind_against_plain_regex(spark, tagger):
    r = random.Random(22)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+49 30 1234567", "10.0.0.1", "300.1.2.3", "a.b@c.org", "7", " ", "-", ".", "+", "@", "é", "x"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text
    rows = pii.find_pii(docs(spark, *texts[:200]), tagger).collect()
    for row in rows:
        own = plain_spans(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in own)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[2] == k for s in own) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(row.spans.split(",")) and row.n_spans == len([s for s in row.spans.split(",") if s])


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train_tagger(pii.labelled_table(spark))


def test_viterbi_is_exact(tagger):
    text = "call (743) 555-3824"
    tokens = pii.tokens_of(text, 0, len(text))[:4]
    names = pii.features(tokens, text)
    scores = [tagger.weights[n].sum(axis=0) for n in tagger.numbers(names)]
    value = lambda path: tagger.starts[path[0]] + sum(s[k] for s, k in zip(scores, path)) + sum(tagger.moves[a, b] for a, b in zip(path, path[1:]))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=value)
    assert list(best) == tagger.decode([4], lambda i, lo, hi: names[lo:hi])[0]


def test_gradient_reaches_the_labels():
    model = crf.train([[["a"], ["b"]], [["b"], ["a"]]], [[0, 1], [1, 0]], 2)
    sequences = [[["a"], ["b"], ["a"]], [], [["zzz"]]]
    assert model.decode([3, 0, 1], lambda i, lo, hi: sequences[i][lo:hi])[0] == [0, 1, 0]


def test_tagger_on_held_out_forms(tagger):
    ask = lambda t: pii.add_spans([t], [pii.base_spans(t)], tagger)[0]
    for text, kind in (("ring 212-555-0187 now", "phone"), ("or (212) 555-0187 then", "phone"), ("write bob [at] site [dot] com soon", "email"), ("card 4111.1111.1111.1111 ok", "card")):
        assert [s[2] for s in ask(text)] == [kind], text
    for text in ("on 2024-01-02 we met 12 people", 'token = "04dbebab91ab8568"', "pages 10, 20 and 30", "plain words only"):
        assert ask(text) == [], text


def test_find_and_mask(spark, tagger):
    df = docs(spark, *ODD, "mail a.b@c.org, a.b@c.org", "x 10.0.0.1 " * 100)
    rows = {r.doc_id: r for r in pii.find_pii(df, tagger).collect()}
    n = len(ODD)
    assert rows[n].n_email == 2 and rows[n].spans == "email:5:14,email:16:25" and rows[0].spans == "" and rows[n + 1].n_ip == 100
    assert rows[n].base_sha256 == hashlib.sha256(b"email:5:14,email:16:25").hexdigest()
    masked = {r.doc_id: r for r in pii.mask_pii(df, tagger).collect()}
    assert masked[n].text == "mail [EMAIL], [EMAIL]" and masked[0].text is None and masked[5].text == ODD[5] and masked[n + 1].text == "x [IP] " * 100 and masked[n].fp == "x"
    assert pii.find_pii(df.limit(0), tagger).count() == 0


def test_labelled_table_is_bounded(spark):
    with pytest.raises(ValueError):
        pii.train_tagger(spark.range(pii.MAX_LABELLED + 1).select(F.lit("a 1").alias("text"), F.lit("").alias("spans")))


# ---- url filter


def pages(spark, *rows):
    return spark.createDataFrame([(i, *r, 0.5) for i, r in enumerate(rows)], "page_id long, url string, html string, trust double")


def test_hosts_paths_rules(spark):
    cases = {
        "https://WWW.Example.com/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/"),
        "http://example.com/fr/": ("example.com", "/fr/", "com/"),
        "http://example.com": ("example.com", "", None),
        "ftp://x.net/es/1": ("x.net", "/es/1", "net/es/"),
        "http://xnet/es/": ("xnet", "/es/", None),
        "no scheme/a": ("", "", None),
        "": ("", "", None),
        "http://h?://other/p": ("h", "", None),
        "line\nhttp://K.org/é": ("k.org", "/é", None),
    }
    rows = urlfilter.judge_urls(pages(spark, *[(u, None) for u in cases], (None, None))).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows[:-1]] == list(cases.values()) and (rows[-1].host, rows[-1].path, rows[-1].verdict) == ("", "", "allow")
    assert urlfilter.judge_urls(pages(spark, ("http://a.org/", "")).limit(0)).count() == 0


def test_propagation_against_loop(spark):
    r = random.Random(6)
    hosts = [f"h{i}.org" for i in range(12)] + ["t.com", "b.net"]
    rows = []
    for h in hosts:
        for _ in range(3):
            links = "".join(f'<a href="http://{r.choice(hosts)}/p">' for _ in range(3)) + '<a href="/own">'
            rows.append((f"http://{h}/{'es' if h == 'b.net' else 'x'}/", links))
    rows += [("http://lonely.org/", "")]
    got = {x.host: (x.verdict, x.trust, x.distrust) for x in urlfilter.judge_urls(pages(spark, *rows)).collect()}
    edges = Counter()
    for url, html in rows:
        host = url.split("/")[2]
        for link in re.findall(r'href="([^"]*)"', html):
            edges[host, link.split("/")[2] if "://" in link else host] += 1

    def rank(edges, seeds):
        total = Counter()
        for (a, _), n in edges.items():
            total[a] += n
        now = dict(seeds)
        for _ in range(250):
            new = Counter({h: (1 - urlfilter.DAMPING) * s for h, s in seeds.items()})
            for (a, b), n in edges.items():
                new[b] += urlfilter.DAMPING * now.get(a, 0) * n / total[a]
            now = new
        return now

    trust, distrust = rank(edges, {"t.com": 1.0}), rank(Counter({(b, a): n for (a, b), n in edges.items()}), {"b.net": 1.0})
    for h in hosts[:-2]:
        verdict, t, d = got[h]
        assert t == pytest.approx(trust[h], rel=1e-5) and d == pytest.approx(distrust[h], rel=1e-5) and verdict == ("block" if distrust[h] > trust[h] else "allow")
    assert got["lonely.org"][0] == "allow"


def test_relative_links_are_the_own_hosts(spark):
    hrefs = {"next.html": 1, "?page=2": 1, "../up": 1, "/root": 1, "#part": 0, "mailto:a@b.org": 0, "javascript:go()": 0, "//other.org/x": None}
    rows = pages(spark, ("http://a.org/", "".join(f'<a href="{h}">' for h in hrefs)))
    links = urlfilter.host_links(rows.select(urlfilter.host_of(F.col("url")).alias("host"), "html")).collect()
    assert sorted((r.src, r.dst, r.weight) for r in links) == [("a.org", "a.org", 4.0), ("a.org", "other.org", 1.0)]


def test_long_chains_have_no_limit(spark):
    """A chain of 150 hosts; every rank is what 0.85 leaves of the seed, to the last."""
    rows = [("http://b.net/es/", "")] + [(f"http://h{i}.org/", f'<a href="http://{"b.net" if not i else f"h{i - 1}.org"}/">') for i in range(150)]
    got = {r.host: r for r in urlfilter.judge_urls(pages(spark, *rows)).collect()}
    for i in range(150):
        assert got[f"h{i}.org"].distrust == pytest.approx(0.15 * 0.85 ** (i + 1), rel=1e-5) and got[f"h{i}.org"].verdict == "block"


def test_distrust_reaches_far(spark):
    """A chain of 40 links to a blocked host, repeated rows, and columns named as the operator's own."""
    rows = [("http://b.net/es/", "")] + [(f"http://h{i}.org/", f'<a href="http://{"b.net" if not i else f"h{i - 1}.org"}/">') for i in range(40)]
    df = pages(spark, *rows, *rows[5:8]).withColumns({"rule": F.lit("r"), "host": F.lit("x"), "kind": F.lit(1)})
    out = urlfilter.judge_urls(df).collect()
    assert len(out) == 44 and all(r.verdict == "block" for r in out) and len({r.host for r in out}) == 41



# ---- top k


def brute(vectors, k=20, every=20):
    """Sorted rows; every row is a candidate but the query's own."""
    rows = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            scored = sorted((-dot(v, w), c) for j, (c, w) in enumerate(rows) if j != n)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_brute_force(spark):
    r = random.Random(3)
    make = {"normal": lambda: [r.gauss(0, 0.2) for _ in range(8)], "ties": lambda: [r.choice([0.0, 1 / 64, -1 / 64]) for _ in range(4)], "large": lambda: [r.gauss(0, 1e6) for _ in range(8)], "spread": lambda: [r.choice([0.0, 0.01, 30.0]) * r.gauss(0, 1) for _ in range(16)]}
    for name, one in make.items():
        vectors = [(i, one()) for i in range(150)]
        vectors += [*vectors[:3], (20, one()), (40, one()), (7, one())]  # repeated rows and repeated ids
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        for block, query_block, wave in ((1000, 1000, 9), (32, 3, 2)):
            got = topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0, block=block, query_block=query_block, wave=wave)
            assert sorted(tuple(x) for x in got.collect()) == brute(vectors), name


@pytest.mark.parametrize("floor", [-np.inf, 40.0, 1e9])
def test_search_stops_on_proof(floor):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-3, 4, (2000, 16))
    vectors[:30] *= 20
    vectors[40] = 0
    block = topk.indexed(np.arange(2000)[::-1], np.arange(2000), vectors)
    whole = np.zeros_like(vectors)
    for part in block.segments():
        size = np.abs(block.value[part])
        assert size.min() > size.max() // 2 > 0 or size.max() == 1
        whole[block.at[part], block.dim[part]] += block.value[part]
    assert (whole == vectors[block.rows]).all()
    found = list(topk.search(vectors[:5], np.arange(5), np.full(5, floor), block, members=64))
    assert sorted(x[0] for x in found) == list(range(5))
    for row, at, scores in found:
        exact = vectors @ vectors[row]
        want = [j for j in np.lexsort((np.arange(2000)[::-1], -exact)) if j != row and exact[j] >= floor][:20]
        assert [x for x, s in zip(block.rows[at].tolist(), scores) if s >= floor] == want and scores.tolist() == exact[block.rows[at]].tolist()


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (20, [1.0, None], 1), (40, None, 1), (60, [float("nan"), 1.0], 1), (80, [float("inf"), 1.0], 1), (100, [], 1), (3, [1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = sorted(tuple(x) for x in topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 3, 4096), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 3, 0)]
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


# ---- quality


def quality_rows(spark, n=300):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 8)))
    texts = [" ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(r.randint(20, 60))) for i in range(n)]
    df = docs(spark, *texts)
    return df, spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(n)] + [(7, None), (8, 5), (None, 1)], "doc_id long, quality int")


def test_held_out_accuracy_and_leaks(spark):
    df, labels = quality_rows(spark)
    model = quality.train(df, labels)
    rows = quality.score_all(df, model).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in rows if r.held_out]) > 0.95
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert [r.score for r in quality.score_all(df, quality.train(df, flipped)).collect()] == [r.score for r in rows]


def test_quality_odd_rows_and_filter(spark):
    df, labels = quality_rows(spark)
    model = quality.train(df, labels)
    rows = quality.score_all(odd(spark), model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    good = {(r.doc_id, r.predicted) for r in quality.score_all(df, model).collect() if r.predicted}
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in good}
    assert quality.score_all(df.limit(0), model).count() == 0
    none = quality.train(df, labels.limit(0))
    assert all(r.predicted == 1 for r in quality.score_all(df, none).collect())


def plain_description(text):
    """FEATURES one by one, by plain loops."""
    body = (text or "").encode()
    if not body:
        return [0.0] * len(quality.FEATURES)
    space, n = b" \t\n\r\x0b\x0c", len(body)
    words, word = [], b""
    for c in body + b" ":
        if c in space:
            words, word = [*words, word] if word else words, b""
        else:
            word += bytes([c])
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    share = lambda test: sum(map(test, body)) / n
    w = max(1, len(words))
    return [
        np.log(n + 1), np.log(len(words) + 1), sum(map(len, words)) / w, share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b"#$%&*@^~<>=+/\\{}[]_"),
        share(lambda c: c in b"!?"), share(lambda c: c == 124), share(lambda c: c == 46), share(lambda c: c in b",;:"), share(lambda c: c >= 128), share(lambda c: c == 32), share(lambda c: c == 10),
        len(set(low)) / w, len(set(body.split(b"\n"))) / len(body.split(b"\n")), sum(a == b for a, b in zip(low, low[1:])) / w, sum(x.istitle() for x in words) / w, sum(len(x) > 20 for x in words) / w,
    ]


def test_scores_against_plain_rule(spark):
    """Features by loops, fit by its own optimum, score by the logistic rule."""
    df, labels = quality_rows(spark)
    texts = [*ODD[:6], "A b C!? #x 12,5|é\n\na a", *[r.text for r in df.limit(30).collect()]]
    for text in texts:
        if text is None or len(text) < 5000:
            assert np.allclose(quality.describe(None if text is None else text.encode()), plain_description(text)), text
    model = quality.train(df, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = {r.doc_id: r.text for r in df.collect()}
    x, y = np.array([plain_description(rows[i]) for i in known]), np.array(list(known.values()))
    design = np.hstack([np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9), -4, 4), (x[:, :, None] >= np.quantile(x, np.arange(1, quality.BINS) / quality.BINS, axis=0).T[None]).reshape(len(x), -1)])
    strength = design @ model.weights
    bad = (y == 0).sum()
    order = np.sort(strength)
    assert model.threshold == pytest.approx((order[bad - 1] + order[bad]) / 2)
    gap = design[y == 1][:, None] - design[y == 0][None]  # every preference pair; the fit draws some of them
    loss = lambda w: np.log1p(np.exp(-(gap @ w))).mean()
    assert loss(model.weights) < 0.1 * loss(np.zeros_like(model.weights))
    scores = {r.doc_id: r.score for r in quality.score_all(df, model).collect()}
    for i, s in zip(known, strength):
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-((s - model.threshold) / model.width + np.log(3 / 7)))), abs=1e-9)


def test_pairs_order_strengths():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    good = (x[:, 0] + 0.5 * x[:, 3] > 0.3).astype(int)
    s = quality.fit(x, good).strength(x)
    assert np.mean(s[good == 1][:, None] > s[good == 0][None]) > 0.97


# ---- mixing


def lang_rows(spark, n=240):
    r = random.Random(4)
    alphabets = {"de": "äöüchs", "en": "thewon", "es": "ñóaros", "fr": "éèêoux"}
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else r.choice(list(alphabets))
        rows.append((i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(5)) for _ in range(r.randint(5, 80))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixing_meets_targets(spark):
    df = lang_rows(spark)
    rows = mixing.mix(df, df.where("doc_id % 3 = 0")).collect()
    names = sorted(mixing.TARGETS)
    total = sum(r.tokens for r in rows)
    for k, n in enumerate(names):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in rows) - mixing.TARGETS[n] * total) < 1e-3 * total
    truth = {r.doc_id: r.lang for r in df.collect()}
    assert np.mean([names[int(np.argmax(r.p))] == truth[r.doc_id] for r in rows if r.doc_id % 3]) > 0.95
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def least_squares(p, t, targets, floor, rounds=20_000):
    """Another way to rates of floor or more of least squared distance: gradient descent in the metric t, a step of one over the largest curvature, nothing else."""
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    r = np.full(len(t), max(1.0, floor))
    for _ in range(rounds):
        r = np.maximum(floor, r - step * (p @ ((r * t) @ p - targets)))
    return r


@pytest.mark.parametrize(("floor", "shares", "soft", "aim"), [(0.0, (0.4, 0.3, 0.2, 0.1), 0.1, (0.05, 0.4, 0.3, 0.25)), (1.0, (0.94, 0.02, 0.02, 0.02), 0.3, (1.0, 0.5, 0.3, 0.3)), (1.0, (0.4, 0.3, 0.2, 0.1), 0.2, (0.1, 0.3, 0.3, 0.3)), (1.0, (0.4, 0.3, 0.2, 0.1), 0.1, (0.3, 0.4, 0.3, 0.2)), (1.0, (0.94, 0.02, 0.02, 0.02), 0.3, None), (1.0, (0.9, 0.04, 0.03, 0.03), 0.3, None), (0.0, (0.25, 0.25, 0.25, 0.25), 0.9, (0.45, 0.2, 0.2, 0.15)), (0.0, (0.25, 0.25, 0.25, 0.25), 0.98, (0.45, 0.2, 0.2, 0.15))])
def test_solver_against_least_squares(spark, floor, shares, soft, aim, caplog):
    """Targets that rates can meet and targets that floors keep away; small and absent domains."""
    r = np.random.default_rng(2)
    own = np.repeat(np.arange(4), np.round(np.array(shares) * 600).astype(int))
    p = np.round((1 - soft) * np.eye(4)[own] + soft * r.dirichlet(np.ones(4), len(own)), 9)
    t = r.integers(0, 400, len(own)).astype(float)
    targets = np.array(aim) * t.sum() if aim else np.array([0.2, 0.45, 0.15, 0.2]) * (t @ p / [0.2, 0.45, 0.15, 0.2]).max() * 1.02
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(t, p)], "tokens long, p array<double>").coalesce(1).cache()
    with caplog.at_level("INFO", logger="hindsail.llm.mixing"):
        rates = mixing.solve(df, targets, floor)
    got = np.array([x[0] for x in df.select(rates.of(F.col("p"))).collect()])
    miss = lambda rates: (rates * t) @ p - targets
    other = miss(least_squares(p, t, targets, floor))
    slack = mixing.TOLERANCE * targets.sum()
    assert got.min() >= floor and np.linalg.norm(miss(got)) <= np.linalg.norm(other) * 1.02 + 2 * slack, (miss(got), other, len(rates.steps))
    assert f"{np.abs(miss(got)).max() / targets.sum():.4f}" in caplog.text
    assert np.allclose(rates.reached, miss(got) + targets, rtol=1e-6) and (rates.status == "met") == (np.abs(miss(got)).max() <= slack * 1.001)


def test_mixing_odd_rows(spark):
    df = docs(spark, *ODD).withColumn("lang", F.lit("en"))
    labelled = mixing.labelled_sample(df, spark.createDataFrame([(0, 1), (4, 1), (4, 0), (None, 1)], "doc_id long, quality int"))
    assert {r.doc_id for r in labelled.collect()} == {0, 4}
    assert mixing.mix(df, labelled).count() == len(ODD) and mixing.mix(df.limit(0), labelled.limit(0)).count() == 0
    clash = lang_rows(spark).withColumns({"mixing_p": F.lit("a"), "MIXING_tokens": F.lit(1), "mixing_copy": F.lit(2)})
    out = mixing.resample(clash, lang_rows(spark).limit(100))
    assert out.columns == clash.columns and out.select("doc_id", "mixing_p", "MIXING_tokens", "mixing_copy").distinct().count() == 240


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Families of edited, appended and shuffled copies, chains, exact copies, short and empty texts."""
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(60, 200))) for _ in range(25)]
    for base in texts[:12]:
        words = base.split()
        for edits in (1, 1, 2, 2, 3):
            own = list(words)
            for _ in range(edits):
                own[r.randrange(len(own))] = "x" + r.choice(vocabulary)
            texts.append(" ".join(own))
        texts.append(base + " " + " ".join(r.choice(vocabulary) for _ in range(len(words) // 10)))
    family = texts[13].split()
    for i in range(60):
        own = list(family)
        own[i % len(own)] = f"z{i}"
        texts.append(" ".join(own))
    common = " ".join(f"passage{i}" for i in range(40))  # shared by unlike texts
    texts += [f"{common} " + " ".join(r.choice(vocabulary) for _ in range(n)) for n in (5, 8, 60, 80, 300) for _ in range(6)]
    texts += [texts[0], texts[0].upper(), None, "", "one two", "one two", "three", "\x85\u2003", " \n"]
    df = docs(spark, *texts, start=100)
    got = {x.key: x.component_id for x in simhash.near_copies(df).collect()}
    sets = [set(simhash.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) and find(i) != find(j):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    assert [got[hashlib.md5((t or "").encode()).hexdigest()] for t in texts] == [100 + find(i) for i in range(len(texts))]
    assert simhash.near_copies(df.limit(0)).count() == 0
    monkeypatch.setattr(simhash, "PART", 500)
    assert {x.key: x.component_id for x in simhash.near_copies(df.repartition(3)).collect()} == got


def test_guaranteed_counts():
    """Sets at the similarity share, of what both post, the number that suspects() asks for."""
    r = np.random.default_rng(4)
    for _ in range(4000):
        shared, more, less = r.integers(1, 120), *r.integers(0, 16, 2)
        ours = r.choice(1 << 40, shared + more + less, replace=False)
        a, b = np.sort(ours[: shared + more]), np.sort(np.concatenate([ours[:shared], ours[shared + more :]]))
        if shared >= 0.8 * len(ours):
            met = len(np.intersect1d(a[: simhash.posted(len(a), 0.8)], b[: simhash.posted(len(b), 0.8)]))
            assert all(met >= 1 + np.floor(0.08 * len(x) - 1e-6) for x in (a, b))


def test_near_copies_of_distant_words_prints(spark):
    """Copies whose fingerprints differ in more than 24 of 128 bits, but share three bytes, are verified too."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def words_print(words, seed):
        import xxhash

        hashes = [xxhash.xxh64_intdigest(w, seed) for w in set(words)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    pairs = []
    while len(pairs) < 4:
        base = [word() for _ in range(40)]
        copy = base + [word() for _ in range(8)]
        differ = [words_print(base, s) ^ words_print(copy, s) for s in (42, 43)]
        if sum(d.bit_count() for d in differ) > 24 and max(sum(not d >> 8 * k & 255 for k in range(8)) for d in differ) >= 3:
            pairs.append((" ".join(base), " ".join(copy)))
    df = docs(spark, *[t for pair in pairs for t in pair])
    got = {x.key: x.component_id for x in simhash.near_copies(df).collect()}
    parts = [[got[hashlib.md5(t.encode()).hexdigest()] for t in pair] for pair in pairs]
    assert parts == [[2 * i, 2 * i] for i in range(4)]


def test_near_copies_of_longer_and_shorter_copies(spark):
    """No copy is missed that has up to a fifth of fresh text appended or cut off, or a stretch replaced."""
    r = random.Random(9)
    fresh = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    pairs = []
    for n in (20, 50, 100, 300, 1000):
        for share in (0.15, 0.17, 0.19):
            for _ in range(10):
                base = fresh(n)
                pairs += [(base, base + fresh(int(n * share))), ((base := fresh(n)), base[int(n * share) :])]
    for _ in range(40):
        base = fresh(100)
        pairs.append((base, base[:40] + fresh(6) + base[46:]))
    df = docs(spark, *[" ".join(t) for pair in pairs for t in pair])
    got = {x.key: x.component_id for x in simhash.near_copies(df).collect()}
    missed = near = 0
    for i, pair in enumerate(pairs):
        x, y = (set(simhash.shingle_set(" ".join(t).encode(), 5).tolist()) for t in pair)
        parts = [got[hashlib.md5(" ".join(t).encode()).hexdigest()] for t in pair]
        alike = len(x & y) >= 0.8 * len(x | y)
        near += alike
        missed += alike and parts[0] != parts[1]
        assert alike or parts == [2 * i, 2 * i + 1]
    assert near > 200 and missed == 0, (near, missed)
