import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, records, tokens, warc
from tessera.llm.common import new_path, trimmed


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder(tokens.default_vocabulary())


def plain(coder, text):
    return coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoder_is_the_tokenizer(coder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [plain(coder, t) for t in texts]


def test_encoder_special_cases(coder):
    for t in ["<|endoftext|> A <|ENDOFTEXT|>b", "it's They'RE 3,5km x²", "é\x1c\x85 z", "don't!!'s 'S", "İstanbul ΣΑΣ ﬁ", "%%% the&&& a,b", "K Ångström é"]:
        assert np.frombuffer(coder.encode([t])[0], "<u4").tolist() == plain(coder, t)


def test_encoder_keeps_a_bounded_number_of_words(coder, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    own = tokens.Encoder(tokens.default_vocabulary())
    name = lambda k: "".join(chr(97 + k // 26**p % 26) for p in range(4))
    for texts in ([" ".join(f"{name(k)}!{'?' * (k % 5)}" for k in range(i, i + 300)) for i in (0, 100)], ["x1y2 aaaa aaaa!"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [plain(coder, t) for t in texts]
        assert len(own.known) <= 50


def test_a_task_without_tokens_gives_the_encoder_up():
    tokens.encoder(tokens.default_vocabulary())
    assert list(trimmed(iter, keep=True)([1])) == [1] and tokens.encoder.cache_info().currsize == 1
    assert list(trimmed(iter)([1])) == [1] and tokens.encoder.cache_info().currsize == 0


def test_records_round_trip(spark, odd, coder):
    folder = new_path(spark, "records")
    manifest = records.write_records(odd, folder)
    got = records.read_records(manifest).orderBy("start").collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in texts]
    at = 0
    want = defaultdict(list)
    for known, i, t in texts:
        want[i if known else None].append(plain(coder, t) + [2])
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[r.doc_id]]
    one = manifest.first()
    ids = records.read_at(one.path, [one.records - 1, 0])
    assert len(ids) == 2 and ids[0][1][-1] == 2
    assert records.token_records(odd.limit(0)).count() == 0


def test_damaged_record_is_refused(tmp_path):
    import io

    whole = records.frame(b"payload")
    assert list(records.unframe(io.BytesIO(whole * 2), "x")) == [b"payload"] * 2
    for k in range(len(whole)):
        bad = bytearray(whole)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bytes(bad)), "x"))
    with pytest.raises(ValueError):
        list(records.unframe(io.BytesIO(whole[:-1]), "x"))


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_documents(odd, coder):
    rows = packing.pack_documents(odd, capacity=64).collect()
    used = check_packing(rows, 64)
    total = sum(len(plain(coder, r.text or "")) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == total and used == -(-total // 64)
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert [s for _, s, _ in long] == [64 * i for i in range(len(long))] and all(n == 64 for *_, n in long[:-1])
    assert packing.pack_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("group_bins,over", [(4, 0.12), (64, 0.05), (1000, 0.01)])  # groups of a few bins are packed well each, not together
def test_exchange_closes_gaps(spark, group_bins, over):
    rng = np.random.default_rng(5)
    length = np.r_[rng.integers(1, 101, 3000), np.full(50, 60)]
    cut = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(length)], packing.PIECES)
    rows = packing.pack(cut, capacity=100, group_bins=group_bins).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(length)))
    bound = packing.lower_bound(length, 100)
    assert bound <= check_packing(rows, 100) <= bound * (1 + over) + 2


def test_bounds_are_bounds():
    assert packing.lower_bound(np.full(10, 51), 100) == 10
    assert packing.lower_bound(np.full(9, 34), 100) == 5
    assert packing.lower_bound(np.array([], int), 100) == 0
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(1, 101, rng.integers(1, 30))
        bins, _ = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= bins.max() + 1


def test_warc_round_trip(spark):
    big = "<html>" + "page " * 4000
    pages = [(3, "http://a b/é", big), (1, "http://x", big), (2, None, None), (4, "u", "tiny"), (5, "u", "tiny"), (None, "u", big), (6, "v", "é" * 50), (7, "v", "é" * 50), (7, "v", "é" * 50)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(df, new_path(spark, "warc"))
    for width in (1 << 23, 700, 40):
        rows = warc.read_archives(archives, width).collect()
        assert len(rows) == len(pages)
        for r in rows:
            html = next((h or "") for i, _, h in pages if i == r.page_id)
            same = [i for i, _, h in pages if (h or "") == html and i is not None]
            first = min(same) if same and len(html.encode()) >= 100 and len(same) > 1 else None
            assert r.payload_bytes == len(html.encode())
            if r.page_id == first or first is None:
                assert (r.record_type, r.refers_to) == ("response", None) and r.payload == html.encode()
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)
    assert warc.pages_by_archive(df.limit(0)).count() == 0


def test_reader_skips_false_magic():
    import io

    one = warc.member(1, "u", b"a" * 50, "d", None)
    fake = warc.MAGIC + b"\x00" * 20
    got = list(warc.members(io.BytesIO(fake + one + one), 0, len(fake) + 2 * len(one)))
    assert [at for at, _ in got] == [len(fake), len(fake) + len(one)]
    assert [at for at, _ in warc.members(io.BytesIO(one + one), 1, len(one) + 1)] == [len(one)]
    assert list(warc.members(io.BytesIO(one + one), 1, len(one))) == []
