"""Operators against brute force on small fixtures and the smallest tables."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from urllib.parse import quote_from_bytes

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ledgerfold.llm import chat, decontaminate, fixity, licenses, media, mixing, near_dedup, registry, secrets, token_shards, toxicity
from ledgerfold.llm.common import cut, shared_path, table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# --- 1 ---------------------------------------------------------------------------


def test_license_rules_in_order(spark):
    s = licenses.SENTENCES
    texts = [
        (1, f"{s['apache-grant']} {s['apache-use']} You may obtain a copy of the License at\nhttp://x\n{s['apache-asis']}"),
        (2, f"MIT License\n\nCopyright me\n\n{s['mit-grant']}\n{s['mit-notice']}"), (3, "released UNDER the mit-license!! No more. All rights reserved."),
        (4, f"{s['gpl3-work']} {s['ccbync-grant']}"), (5, "A text about the Apache License.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got[1].matches == ["Apache-2.0"]
    # Identifiers, not lines between them, decide: the copyright line is unknown.
    assert got[2].matches == ["MIT"] and got[2].sentence_ids == ["mit-title", "mit-grant", "mit-notice"]
    assert got[3].matches == ["MIT", "Proprietary"] and got[4].matches == ["GPL-3.0-only", "CC-BY-NC-4.0"] and got[5].matches == []


def test_every_catalogue_sentence_whole_and_wrapped(spark):
    rows, prefixes = [], ("", "# ", " * ", "// ")
    for n, (k, v) in enumerate(licenses.SENTENCES.items()):
        words = v.split(" ")
        rows += [(k, v), (k, f"Some text. {v}\nMore text."), (k, f"Before\n\n{v}\n\nafter")]
        for width in (1, 3, 7):
            lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
            rows.append((k, "\n".join(prefixes[n % 4] + x for x in lines) + "\r\n"))
    rows += [(None, "Released under\n\nthe MIT License."), (None, "Released under. The MIT License."), (None, "unReleased under the MIT\nLicense."),
             ("mpl-grant,mit-title", f"{licenses.SENTENCES['mpl-grant']}\nMIT License\n \t\nx")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = licenses.scan_licenses(docs).collect()
    assert [(r.doc_id, ",".join(r.sentence_ids)) for r in got] == [(k, k or "") for k, _ in rows]
    assert {r.doc_id: r.matches for r in got}["mpl-grant"] == ["MPL-2.0"]
    assert got[-1].n_sentences == 4 and [r.n_sentences for r in got if r.doc_id is None] == [2, 2, 2]


# --- 2 ---------------------------------------------------------------------------


def test_fixity_descends_to_the_damage(spark, sf_dir):
    records = cut(fixity.warc_records(table(spark, sf_dir, "pages"), archive_records=64), "records")
    bad = fixity.damaged(records)
    out = fixity.audit(records, bad, leaf_bytes=4096, fanout=2)
    check = lambda i: zlib.crc32(str(i).encode())
    ids = [r.record_id for r in records.select("record_id").collect()]
    want = {(i, "missing") for i in ids if check(i) % 97 == 5} | {(i, "payload") for i in ids if check(i) % 97 != 5 and check(i) % 89 == 3}
    assert want and {(r.record_id, r.problem) for r in out["findings"].collect()} == want
    touched = {r.archive for r in out["findings"].collect()}
    assert {r.archive for r in out["roots"].collect() if not r.intact} == touched
    raw = records.orderBy("archive", "offset").collect()
    at = defaultdict(int)
    for r in raw:
        assert r.offset == at[r.archive] and bytes(r.payload).startswith(b"WARC/1.1\r\n") and len(r.payload) == r.length
        at[r.archive] += r.length


# --- 3 ---------------------------------------------------------------------------

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}


def brute_spans(text):
    out = []
    for i, (kind, (p, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), i, m.end(), kind) for m in p.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in secrets.op3_secret_scan(spark, sf).collect()}
    assert len(got) == len(documents) and any(r.n_assign + r.n_access + r.n_hex for r in got.values())
    for i, text in documents.items():
        assert got[i].base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest()


def test_nested_layers_map_to_the_original():
    inner = "token = abcdefgh12345678"
    b64 = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(base64.b64encode(inner.encode())).decode()
    url = "".join(f"%{b:02x}" for b in inner.encode())
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    for run in (b64, twice):
        text = f"x {run} y"
        assert (2, 0, 2 + len(run)) in secrets.find(text)["spans"]
    assert secrets.find(f"é {url}!")["spans"] == [(2, 0, 2 + len(url))]
    assert (3, 0, 3 + len(escaped)) in secrets.find(f"é: {escaped}!")["spans"]
    part = "password=%61bcdefgh%31"  # a secret that is partly escaped
    assert secrets.find(part)["spans"] == [(0, 0, len(part))]
    nested = "".join(f"%{b:02x}" for b in f"v={b64} ".encode())
    found = secrets.find(nested)["spans"]
    assert found and all(0 <= a < b <= len(nested) for a, _, b in found)
    bomb = base64.b64encode(zlib.compress(b"a" * 100_000)).decode()
    assert secrets.find(bomb, max_layer_bytes=1000)["refused"] == 1
    both = secrets.find(f"{twice} and {twice}")["spans"]  # equal content at two places
    assert both == [(0, 0, len(twice)), (len(twice) + 5, 0, 2 * len(twice) + 5)]
    assert secrets.find("%2525252541")["layers"] == 5  # one layer a decoding, then a fixpoint


@pytest.mark.parametrize("mark", ["\u00a0", "\ufeff", "\u200b", "\u00ad", "\0", "\x1b", "\f"])
def test_layers_with_unprintable_characters_are_scanned(mark):
    inner = f"{mark}password=abcdefgh1234 {mark}"
    whole = lambda run: (2, 0, 2 + len(run))
    span = lambda raw: (run := base64.b64encode(raw).decode(), secrets.find(f"x {run} y"))
    for raw in (inner.encode(), gzip.compress(inner.encode()), inner.encode("utf-16"), inner.encode("utf-16-be"), inner.encode("utf-32"), inner.encode() + b"\xff",
                base64.b64encode(inner.encode("utf-16")) + mark.encode()):
        run, found = span(raw)
        assert whole(run) in found["spans"]
    run = "".join(f"%{b:02x}" for b in mark.encode() + b"\xff" + b"password=abcdefgh1234")
    first = 3 * len(mark.encode()) + 3
    assert secrets.find(f"é {run}")["spans"] == [(2 + first, 0, 2 + len(run))]
    assert secrets.find(base64.b64encode(bytes(range(128, 160))).decode())["layers"] == 0


def escaped(form):
    return lambda raw: "".join(form.format(b, ord_=b) for b in raw).encode()


def mime(raw):
    return base64.encodebytes(raw).strip()


#: Each makes printable ASCII of any bytes.
TEXTUAL = {
    "url": lambda raw: "".join(f"%{b:02X}" for b in raw).encode(), "quoted": lambda raw: quote_from_bytes(raw).encode(), "b64": base64.b64encode,
    "urlsafe": base64.urlsafe_b64encode, "mime": mime, "hex-escape": escaped("\\x{:02x}"), "unicode": escaped("\\u{:04x}"),
    "braces": escaped("\\u{{{:x}}}"), "long": escaped("\\U{:08x}"), "entity": escaped("&#x{:x};"), "decimal": escaped("&#{:d};"), "percent-u": escaped("%u{:04x}")}
PACKING = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(sorted(PACKING)), max_size=10), st.sampled_from(sorted(TEXTUAL))), min_size=1, max_size=4), st.integers(0, 3))
def test_any_nesting_is_unwrapped(layers, tail):
    """Any number of compressions inside any number of textual forms; the secret is
    all that is encoded, so its span is the whole encoded run."""
    data = b"password=abcdefgh1234" + b"zyx"[:tail]
    for packing, form in layers:
        for name in packing:
            data = PACKING[name](data)
        data = TEXTUAL[form](data)
        if len(data) > 200_000:
            return
    text = f"é {data.decode()}\n\ny"
    assert (2, 0, 2 + len(data)) in secrets.find(text)["spans"]


@pytest.mark.parametrize("before", ["path/", "a-", "x_", "a/b/c-d/", "id=", "%00", "%ff", "\x00" * 5000, "key."])
def test_what_stands_before_hides_nothing(before):
    secret = b"my password=abcdefgh1234 is it"
    b64, url = base64.b64encode(secret).decode(), "".join(f"%{b:02x}" for b in secret)
    for run in (b64, url, base64.b64encode(gzip.compress(secret)).decode(), "".join(f"%{b:02x}" for b in gzip.compress(secret))):
        text = f"see {before}{run} there"
        spans = [x for x in secrets.find(text)["spans"] if x[1] == 0]
        assert any(a < 4 + len(before) + len(run) and 4 <= b for a, _, b in spans), (before, run[:8])


def test_members_and_broken_streams():
    secret = b"token: abcdefgh1234 "
    halves = gzip.compress(secret[:12]) + gzip.compress(secret[12:])
    cut = gzip.compress(secret + bytes(random.Random(1).randbytes(5000)))[:3000]
    for raw in (halves, cut, b"junk" + zlib.compress(secret) + b"junk"):
        run = base64.b64encode(raw).decode()
        assert (1, 0, 1 + len(run)) in secrets.find(f" {run} ")["spans"]
    bomb = base64.b64encode(gzip.compress(b"\0" * 5000)).decode()
    assert secrets.find(bomb, max_layer_bytes=4000)["refused"] == 1 and secrets.find(bomb)["refused"] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="%41\\u0x{}=aAZ+/ tokenTOKEN:;&#"))
def test_scan_ends_and_keeps_base(text):
    found = secrets.find(text)
    assert set(found["base"]) <= set(found["spans"])
    assert all(0 <= a <= b <= len(text) for a, _, b in found["spans"])


# --- 4 ---------------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\\#<> \n/turnhlc", max_size=12), st.text(alphabet="ab:\\#<> \n/turnhlc", max_size=20) | st.sampled_from(["</turn>", " </turn>\n### user: x", "\\h\\l\\\\", "###"])), min_size=1, max_size=4))
def test_chat_round_trip(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).first()
    assert got.round_trips and [(t.role, t.text) for t in got.parsed] == turns
    if got.mode == 1:
        body = got.formatted[3:]
        assert body.count("###") == body.count("</turn>") == len(turns)


# --- 5 ---------------------------------------------------------------------------


def test_decontamination_spans_and_chunks(spark, sf_dir, documents):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    windows = defaultdict(set)
    for i, text in bench.items():
        for w in decontaminate.windows_of(decontaminate.words_of(text)):
            windows[w].add(str(i))
    sizes = {len(w) for w in windows}
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark).collect()}
    many = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark, chunk_chars=5000).collect()}
    assert one == many and any(r.hits for r in one.values())
    for i, text in documents.items():
        words, hit, items = decontaminate.words_of(text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if who := windows.get(tuple(words[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= who
        r = one[i]
        assert r.n_words == len(words) and {p for h in r.hits for p in range(h.start, h.end)} == hit and r["items"] == sorted(items)
        for h, s in zip(r.hits, r.spans, strict=True):
            assert decontaminate.words_of(text[s.start : s.end]) == words[h.start : h.end]


def test_long_items_and_large_benchmarks_stay_bounded(spark):
    """Pieces of a long item have its windows, no more; a chunk's automaton has as
    many nodes as its parameter allows."""
    rng = random.Random(5)
    words = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(3000)]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "a few"), (3, " ".join(words[100:130]))], "item_id bigint, text string")
    chunks = list(decontaminate.benchmark_chunks(benchmark, "item_id", "text", 800, 10))
    got = {w for c in chunks for i, t in c if i == "1" for w in decontaminate.windows_of(t.split(" "))}
    assert got == set(decontaminate.windows_of(words)) and len(chunks) > 30
    assert all(decontaminate.Windows(c, 10).nodes() <= (800 // decontaminate.WORD_CHARS + 1) * 10 + 1 for c in chunks)
    docs = spark.createDataFrame([(7, " - ".join(words[90:140]) + " ... A FEW"), (8, "a, but few")], "doc_id bigint, text string")
    for size in (800, decontaminate.CHUNK_CHARS):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark, chunk_chars=size).collect()}
        assert got[7]["items"] == ["1", "2", "3"] and [(h.start, h.end) for h in got[7].hits] == [(0, 52)] and got[8].hits == [] and got[8].n_words == 3
        assert [r.doc_id for r in decontaminate.clean_documents(docs, benchmark, chunk_chars=size).collect()] == [8]


# --- 6 ---------------------------------------------------------------------------


def earliest_deadlines(weights, blocks):
    """Every step looks at all streams anew: (stream, clock at the block's start)."""
    parts, clock = sum(weights.values()), 0
    done, at = Counter(), Counter()
    while any(done[k] < len(blocks[k]) for k in weights):
        due = {k: (math.floor(Fraction(at[k] * parts, a)), math.ceil(Fraction((at[k] + blocks[k][done[k]]) * parts, a)))
               for k, a in weights.items() if done[k] < len(blocks[k])}
        released = [(d, k) for k, (r, d) in due.items() if r <= clock]
        if not released:
            clock = min(r for r, _ in due.values())
            continue
        k = min(released)[1]
        yield k, clock
        n = blocks[k][done[k]]
        done[k], at[k], clock = done[k] + 1, at[k] + n, clock + n


def deviation(order, weights):
    """Most by which a source is before or behind its share of what was emitted, at
    the end of any block; ``order``: (source, size)."""
    parts, seen, all_, worst = sum(weights.values()), Counter(), 0, 0
    for k, n in order:
        seen[k] += n
        all_ += n
        worst = max(worst, max(abs(seen[x] - a / parts * all_) for x, a in weights.items()))
    return worst


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.floats(0.01, 100), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_deviation_is_below_one_block(targets, rng):
    weights = mixing.whole_weights(targets, 128)
    assert sum(weights.values()) == 128 and min(weights.values()) >= 1
    most = rng.choice([1, 3, 50])
    blocks = {k: [rng.randint(1, most) for _ in range(rng.randint(0, 3 * a))] for k, a in weights.items()}
    got = mixing.schedule(weights, blocks)
    assert [(k, t) for k, _, t in got] == list(earliest_deadlines(weights, blocks))
    assert sorted((k, i) for k, i, _ in got) == sorted((k, i) for k, v in blocks.items() for i in range(len(v)))
    whole = {k: [rng.randint(1, most) for _ in range(2000)] for k in weights}
    order = [(k, whole[k][i]) for k, i, _ in mixing.schedule(weights, whole, 600)]
    assert deviation(order, weights) < max(n for v in whole.values() for n in v)


def test_mix_positions(spark, sf_dir):
    """The emitted documents against blocks and a schedule made from the texts."""
    rows = {r.doc_id: r for r in mixing.op6_source_mixing(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    by, size = defaultdict(list), {}
    for r in docs:
        size[r.doc_id] = max(1, len(r.text))
        by[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    total = {k: sum(size[i] for _, i in v) for k, v in by.items()}
    block, place, blocks = -(-sum(total.values()) // 65_536), {}, defaultdict(dict)
    for k, v in by.items():
        at = 0
        for _, i in sorted(v):
            place[i] = (k, at // block)
            blocks[k][at // block] = blocks[k].get(at // block, 0) + size[i]
            at += size[i]
    assert {i: (r.source, r.block) for i, r in rows.items()} == place
    weights = mixing.whole_weights({k: v**0.75 for k, v in total.items()}, 1 << 20)
    names = {k: sorted(v) for k, v in blocks.items()}
    order = list(earliest_deadlines(weights, {k: [v[b] for b in names[k]] for k, v in blocks.items()}))
    turn, want = Counter(), []
    for k, _ in order:
        want.append((k, names[k][turn[k]]))
        turn[k] += 1
    kept = sorted({(r.slot, r.source, r.block) for r in rows.values() if r.kept})
    assert [x[0] for x in kept] == list(range(len(kept))) and [x[1:] for x in kept] == want[: len(kept)]
    # What is emitted, document by document in the mix's order, holds the weights.
    emitted = [(k, blocks[k][b]) for _, k, b in kept]
    largest, real = max(n for v in blocks.values() for n in v.values()), {k: v**0.75 for k, v in total.items()}
    gone = [k for k in total if sum(n for x, n in emitted if x == k) == total[k]]
    upto = min([i for i, _ in enumerate(emitted) if any(sum(n for x, n in emitted[: i + 1] if x == k) == total[k] for k in gone)], default=len(emitted) - 1)
    assert len(kept) > 50 and deviation(emitted[: upto + 1], real) < largest and largest < max(size.values()) + block


def test_small_sources_do_not_end_the_mix(spark):
    rows = [(i, "word " * 40, "ab"[i % 2]) for i in range(400)] + [(400, "stray", None), *[(500 + i, "x", f"s{i}") for i in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.source not in ("a", "b"))
    kept = Counter(r.source for r in got if r.kept)
    assert min(kept["a"], kept["b"]) > 190
    assert mixing.mixed_documents(docs).count() == sum(kept.values())
    # A source with a share of its own still ends it.
    weights = mixing.whole_weights({"a": 0.5, "b": 0.5}, 8)
    end = mixing.horizon(weights, {"a": 40, "b": 400}, weights)
    assert end == 80 and [k for k, _, _ in mixing.schedule(weights, {"a": [10] * 4, "b": [10] * 40}, end)] == ["a", "b"] * 4


def test_sources_beyond_the_limit_are_refused(spark):
    docs = spark.createDataFrame([(i, "x", f"s{i}", "clash") for i in range(12)], "doc_id bigint, text string, source string, lf_key string")
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mix(docs).where("kept").count() == 12
    with pytest.raises(ValueError):
        mixing.mix(docs, max_streams=5)
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={f"s{i}": 1.0 for i in range(12)}, max_streams=5)
    some = mixing.mixed_documents(docs, weights={"s3": 1.0, "s4": 1.0, mixing.REST: 2.0}, max_streams=5)
    assert {r.source for r in some.collect()} >= {"s3", "s4"}
    assert {r.source for r in mixing.mixed_documents(docs, weights={"s3": 1.0, "absent": 3.0}).collect()} == {"s3"}


# --- 7 ---------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op7_toxicity(spark, sf).collect() if r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(np.array(bad) < s).mean() + 0.5 * (np.array(bad) == s).mean() for s in good])
    assert auc > 0.9 and np.mean([s >= 0.5 for s in good]) > 0.75 and np.mean([s >= 0.5 for s in bad]) < 0.02


def synthetic_votes(rows=6000):
    """Hidden classes and four voters that fire given the class, one of them for the
    clean class."""
    rng = np.random.default_rng(7)
    y = rng.random(rows) < 0.3
    rates = [(0.02, 0.5, 1), (0.05, 0.6, 1), (0.02, 0.4, 1), (0.7, 0.06, 2)]
    return y, np.stack([np.where(rng.random(rows) < np.where(y, b, a), vote, 0) for a, b, vote in rates], 1)


def test_label_model_finds_accuracies_without_labels():
    y, votes = synthetic_votes()
    model = toxicity.LabelModel(0.3)
    q = model.fit(votes)
    assert ((q > 0.5) == y).mean() > 0.9
    # Abstaining tells the model nothing, so rates are lower than those drawn from; their order and odds are theirs.
    on, off = model.rate[:3, 1, 1], model.rate[:3, 0, 1]
    assert on[1] > on[0] > on[2] and (on / off > 3).all() and model.rate[3, 0, 2] / model.rate[3, 1, 2] > 2.5
    assert (model.accuracy() > 0.6).all()
    # Other voters, another posterior.
    assert np.abs(toxicity.LabelModel(0.3).fit(votes[:, [1, 3]]) - q).mean() > 0.05
    random_ = np.where(np.random.default_rng(1).random(len(y)) < 0.3, 1, 0)
    assert np.abs(toxicity.LabelModel(0.3).fit(np.stack([random_, random_], 1)) - q).mean() > 0.2


def test_label_model_counts_copies_once():
    y, votes = synthetic_votes()
    alone = toxicity.LabelModel(0.3)
    q = alone.fit(votes)
    copies = toxicity.LabelModel(0.3)
    with_copies = copies.fit(np.concatenate([votes[:, [0, 0, 0, 0]], votes], 1))  # five times the first voter
    assert sorted(copies.parent[[0, 1, 2, 3, 4]] >= 0) == [False, True, True, True, True]
    assert np.abs(with_copies - q).mean() < 0.08 and ((with_copies > 0.5) == (q > 0.5)).mean() > 0.97
    apart = np.concatenate([votes[:, [0, 0, 0, 0]], votes], 1)
    naive = toxicity.LabelModel(0.3)
    naive._forest = lambda *_: np.full(apart.shape[1], -1)  # all taken for independent
    assert np.abs(naive.fit(apart) - q).mean() > 1.5 * np.abs(with_copies - q).mean()


def test_labels_reach_the_label_model_as_counts_only():
    y, votes = synthetic_votes()
    noisy = np.where(np.random.default_rng(3).random(len(y)) < 0.1, ~y, y).astype(float)
    known = toxicity.known_rates(votes, noisy)
    q = toxicity.LabelModel(0.3).fit(votes, known)
    # Rows of equal votes have equal posteriors whatever their labels.
    for v in {tuple(x) for x in votes}:
        assert np.ptp(q[(votes == v).all(axis=1)]) == 0
    assert ((q > 0.5) == y).mean() > ((noisy > 0.5) == y).mean() - 0.03
    again = toxicity.LabelModel(0.3).fit(votes, toxicity.known_rates(votes, noisy[::-1]))
    assert np.abs(again - q).mean() > 0.01


def test_no_voter_is_nested_in_another():
    flat = [*(f"w:{w}" for w in toxicity.seed_words()), "w:slurring", "w:slurred", "s4:slur", "s5:slurr", "w:calm"]
    rows = 400
    y = np.arange(rows) < 60
    own = {"w:slurring": range(30), "w:slurred": range(30, 60), "s4:slur": range(60), "s5:slurr": range(60), "w:calm": range(100, 400)}
    doc = np.concatenate([list(v) for v in own.values()])
    feature = np.concatenate([[flat.index(k)] * len(v) for k, v in own.items()])
    chosen = toxicity.choose_voters(flat, doc, feature, y.astype(int), 300)
    assert [c for c in chosen if c[0][2:] not in toxicity.seed_words()] in ([("s4:slur", 1), ("w:calm", 2)], [("s5:slurr", 1), ("w:calm", 2)])


# --- 8 ---------------------------------------------------------------------------


def test_token_shards_equal_the_library(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_shards.vocabulary_path())
    manifest = token_shards.write_shards(table(spark, sf_dir, "documents"), shared_path(spark, "shards"), shard_chars=100_000)
    assert manifest.count() > 3
    got = {r.doc_id: r for r in token_shards.read_shards(manifest).collect()}
    at = 0
    for i in sorted(documents):
        ids = [*library.encode(documents[i], add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (at, len(ids), ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    some = sorted(documents)[5]
    assert token_shards.lookup(manifest, some).tolist() == got[some].ids and token_shards.lookup(manifest, 10**12) is None


@settings(max_examples=150, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["Don't", "a.b", "É", "ÉTÉ.", "<|endoftext|>", "<|ENDOFTEXT|>", "x1,y", " ", "'re", "…", "日本", "İ", "é."])).map(" ".join))
def test_word_memo_equals_the_library(text):
    memo = token_shards.word_memo()
    assert memo.encode(pa.array([text]))[0].tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded():
    memo = token_shards.WordMemo(token_shards.vocabulary_path(), limit=50)
    rng = random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcde", k=4)) for _ in range(30))
        assert memo.encode(pa.array([text]))[0].tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids
        assert memo.count <= 80


# --- 9 ---------------------------------------------------------------------------


def test_media_round_trip_and_damage(spark, sf_dir, documents):
    path = shared_path(spark, "media")
    written = media.write_archives(table(spark, sf_dir, "documents"), path, archive_bytes=50_000).collect()
    assert len(written) > 2 and sum(r.members for r in written) == len(documents)
    got = {r.doc_id: r for r in media.media_features(media.read_archives(spark, path, rangeBytes=10_000)).collect()}
    for i, text in documents.items():
        raw = text.encode()
        whole = media.padded(raw)
        assert (got[i].n_bytes, got[i].payload_sha256) == (len(raw), hashlib.sha256(whole).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(whole[-64:]) and media.decode_png(media.encode_png(raw)) == (whole, len(raw))
    # The stored images, parsed by the format's own rules.
    for r in media.read_archives(spark, path).collect():
        image, at, chunks = bytes(r.media), 8, {}
        assert image[:8] == b"\x89PNG\r\n\x1a\n"
        while at < len(image):
            n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
            body = image[at + 8 : at + 8 + n]
            assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
            chunks[kind] = chunks.get(kind, b"") + body
            at += 12 + n
        rows = zlib.decompress(chunks[b"IDAT"])
        samples = b"".join(rows[k + 1 : k + 65] for k in range(0, len(rows), 65))
        assert not any(rows[k] for k in range(0, len(rows), 65)) and chunks[b"IHDR"][:10] == (64).to_bytes(4, "big") + (len(samples) // 64).to_bytes(4, "big") + b"\x08\x00"
        mine = [g for g in got.values() if g.payload_sha256 == hashlib.sha256(samples).hexdigest() and g.media_sha256 == hashlib.sha256(image).hexdigest()]
        assert mine and all(g.payload_bytes == len(samples) and g.media_bytes == len(image) and g.feature == media.features(samples) for g in mine)
    local = written[0].archive.removeprefix("file:")
    with open(local, "r+b") as f:  # one member's header
        f.seek(10)
        f.write(b"\xff")
    rows = media.media_features(media.read_archives(spark, path, attempts=2)).collect()
    assert len(rows) == len(documents) and sum(r.error is not None for r in rows) == 1


# --- 10 --------------------------------------------------------------------------


def brute_components(texts, words=4):
    def shingles(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(sets)
    index = defaultdict(list)
    for i in ids:
        for c, k in Counter(j for s in sets[i] for j in index[s]).items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[c]) - k):
                a, b = find(i), find(c)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf_dir, documents):
    got = near_dedup.op10_near_duplicates(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(documents)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_lists_equal_brute_force(spark, monkeypatch):
    """A large group of near copies, a passage that many share, short texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, texts = words(120), words(60), {}
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts[i] = " ".join(copy)
    for i in range(150, 260):
        texts[i] = " ".join(words(rng.choice([5, 20, 90])) + passage)
    for i in range(260, 330):
        texts[i] = " ".join(base[:6] + words(rng.randrange(3)))
    for name, value in (("LIST", 12), ("BLOCK", 32), ("SKETCH", 32), ("POSTED", 16), ("ESTIMATE", 40)):
        monkeypatch.setattr(near_dedup, name, value)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts)


def test_link_by_long_lists_with_few_short_ones(spark, monkeypatch):
    """Two documents that share a passage with many others and one or two shingles
    more, of which one is the smallest of all they have in common."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    passage, own = words(150), [words(16), words(16)]
    texts = {i: " ".join(passage + words(20)) for i in range(80)}
    monkeypatch.setattr(near_dedup, "COUNTED", near_dedup.SKETCH)
    many = near_dedup.shingle_sets(pa.array([" ".join(passage)]))[0]
    while True:
        shared = words(2)
        x, y = near_dedup.shingle_sets(pa.array([" ".join(passage + shared + tail) for tail in own]))
        both = np.intersect1d(x, y)
        if both[0] not in many:
            break
    assert min(len(x), len(y)) >= 160 and near_dedup.linked(len(both), len(x), len(y))
    texts |= {100 + i: " ".join(passage + shared + tail) for i, tail in enumerate(own)}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    want = brute_components(texts)
    assert want[101][1] == 100 and len({c for _, c in want.values()}) == 81
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def components_of(texts):
    """As ``brute_components``, by comparing all pairs; for few long texts."""
    sets = {i: {" ".join(w[k : k + 4]) for w in [t.split()] for k in range(len(w) - 3)} for i, t in texts.items()}
    comp = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * (c := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    while any(comp[i] != comp[j] for i, j in links):
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(sets[i]), c) for i, c in comp.items()}


def test_pairs_in_a_corpus_of_boilerplate(spark):
    """Everything shares 880 words; a pair 18 more, of 116 own ones.  Jaccard is
    0.82 inside a pair and 0.79 between pairs."""
    rng = random.Random(29)
    words = lambda n: [f"{rng.randrange(1 << 48):x}" for _ in range(n)]
    passage, texts = words(880), {}
    for k in range(120):
        shared = words(18)
        for i in (2 * k, 2 * k + 1):
            texts[i] = " ".join(passage + shared + words(98))
    want = components_of(texts)
    assert {c for _, c in want.values()} == set(range(0, 240, 2))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_pairs_of_any_mix_of_rare_and_frequent_shingles(spark):
    """Pairs just above the similarity, of 165 to 3,000 shingles, of which any share
    stands in a passage that 70 others hold; one side may hold all of the other."""
    rng = random.Random(31)
    words = lambda n: [f"{rng.randrange(1 << 48):x}" for _ in range(n)]
    passages = {n: words(n) for n in (60, 150, 400, 1200)}
    texts = {k * 100 + i: " ".join(p + words(len(p))) for k, p in enumerate(passages.values()) for i in range(70)}
    for n in range(100):
        size, own = rng.choice([165, 180, 240, 400, 900, 3000]), rng.random()
        passage = passages[rng.choice([p for p in passages if p < size])] if rng.random() < 0.9 else []
        union = size + rng.randrange(6)
        common = max(-(-union * (80 + rng.randrange(3)) // 100) + 6, len(passage) + 1)
        rest = max(0, union - common)
        first = rest if n % 4 == 0 else int(own * rest)
        shared = passage + words(common - len(passage))
        texts[10_000 + 2 * n], texts[10_001 + 2 * n] = " ".join(shared + words(first)), " ".join(shared + words(rest - first))
    want = components_of(texts)
    assert sum(want[10_001 + 2 * n][1] == 10_000 + 2 * n for n in range(100)) > 60
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_prefix_of_any_order_meets_every_link():
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.randrange(4, 60)
        a = set(range(n))
        b = set(rng.sample(range(n), rng.randrange(int(n * 0.7), n + 1))) | {1000 + i for i in range(rng.randrange(0, max(1, n // 4)))}
        if near_dedup.linked(len(a & b), len(a), len(b)):
            order = list(a | b)
            rng.shuffle(order)
            heads = [set([x for x in order if x in s][: near_dedup.prefix(len(s))]) for s in (a, b)]
            assert heads[0] & heads[1]


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir, documents):
    got = corpus_pipeline.run(spark, sf_dir).orderBy("doc_id").collect()
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    left = {i: t for i, t in documents.items() if model.score(pa.array([t]))[0] < 0.5}
    comps = brute_components(left)
    left = {i: t for i, t in left.items() if comps[i][1] == i}
    bench = {w for r in table(spark, sf_dir, "benchmark").collect() for w in decontaminate.windows_of(decontaminate.words_of(r.text))}
    sizes = {len(w) for w in bench}

    def dirty(t):
        w = decontaminate.words_of(t)
        return any(tuple(w[k : k + n]) in bench for n in sizes for k in range(len(w) - n + 1))

    left = {i for i, t in left.items() if not dirty(t)}
    docs = table(spark, sf_dir, "documents")
    kept = {r.id for r in mixing.mix(docs.where(docs.doc_id.isin(*left))).where("kept").collect()}
    assert [r.doc_id for r in got] == sorted(kept) and 0 < len(kept) <= len(left)


def test_registry():
    names = set(registry.queries())
    assert {int(n.split("_")[0][2:]) for n in names} == set(range(1, 11))
    assert set(registry.oracle_sql()) <= names and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    json.dumps(sorted(names))
