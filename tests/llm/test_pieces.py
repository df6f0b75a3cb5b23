"""Encoding and decoding against the library, also with its compiled character maps."""

from __future__ import annotations

import random
import time
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tallymart.llm.pieces import PieceModel, encode_and_decode, piece_spans
from tallymart.llm.queries import QUERIES
from tallymart.session import ship_package

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    random.seed(1)
    signs = "ab  e▁\n\tñß日本😀́ﬁ① 　İ\0<s></s>0129…​\r"
    some = ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(1500)]
    return [*some, "", " ", "  ", "▁", "▁a", " a ", "<unk>", "<0x0A>", "�", "a" * 3000, "ab " * 2000, "日" * 500]


def models():
    with open(PATH, "rb") as file:
        raw = file.read()
    yield "as it is", raw
    for rule in ("nmt_nfkc", "nfkc", "nfkc_cf"):
        spec = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec
        for squeeze in (True, False):
            changed = pb.ModelProto.FromString(raw)
            changed.normalizer_spec.CopyFrom(spec)
            changed.normalizer_spec.remove_extra_whitespaces = squeeze
            changed.normalizer_spec.add_dummy_prefix = changed.normalizer_spec.escape_whitespaces = True
            yield f"{rule} {squeeze}", changed.SerializeToString()


@pytest.mark.parametrize(("name", "raw"), list(models()), ids=lambda x: x if isinstance(x, str) else "")
def test_same_ids_spans_and_text_as_the_library(name, raw):
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), PieceModel(raw)
    for text in texts():
        ids = [library.bos_id(), *library.encode(text), library.eos_id()]
        assert model.encode(text.encode()).tolist() == ids, text[:60]
        assert model.decode(np.array(ids)) == library.decode(ids).encode(), text[:60]
        wanted = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        got = [(i, begin, end) for i, _, begin, end in model.spans(text.encode())]
        assert [g[0] for g in got] == [w[0] for w in wanted]
        assert all(g == w for g, w in zip(got, wanted, strict=True) if g[0] not in model.byte_value), text[:60]


def test_decoding_loose_bytes():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceModel(open(PATH, "rb").read())
    random.seed(2)
    for _ in range(300):
        ids = [random.randint(0, 300) for _ in range(random.randint(0, 12))]
        assert model.decode(np.array(ids, np.uint32)) == library.decode(ids).encode(), ids


def test_tables(spark):
    ship_package(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (1, "Hello  wörld"), (4, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_tokens string")
    got = encode_and_decode(docs, PATH, with_ids=True).collect()
    assert len(got) == 5
    for row in got:
        text = dict(rows)[row.id] or ""
        ids = [1, *library.encode(text), 2]
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest() and row.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()
    spans = {r.id: r.spans for r in piece_spans(docs.limit(3), PATH).collect()}
    assert spans[2] == [] and spans[1][-1].end == len("Hello  wörld".encode())
    assert encode_and_decode(docs.limit(0), PATH).count() == 0


def test_the_query_makes_the_spans_of_all_pieces(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "Hello  wörld ▁ x"), (2, None), (3, ""), (4, "x " * 5_000), (5, " \n日")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans_sha256 for r in QUERIES["op2_sentencepiece"](spark, f"file://{tmp_path}").collect()}
    for i, text in rows[:4]:
        pieces = library.encode(text or "", return_type="proto").pieces
        assert got[i] == sha256(np.array([(p.begin, p.end) for p in pieces], "<i8").tobytes()).hexdigest()
    assert got[5] == sha256(np.array([m[2:] for m in PieceModel(open(PATH, "rb").read()).spans(rows[4][1].encode())], "<i8").tobytes()).hexdigest()


@pytest.mark.parametrize(("name", "raw"), [m for m in models() if "nfkc_cf" not in m[0]], ids=lambda x: x if isinstance(x, str) else "")
def test_many_texts_at_once_are_as_one_by_one(name, raw, monkeypatch):
    """Parts of texts, cut where they are long, together as ``align`` has each alone."""
    monkeypatch.setattr("tallymart.llm.pieces._PART", 64)
    model = PieceModel(raw)
    spaced = [" " * 200, " " * 63 + "a", "a" + " " * 130 + "b", "  x" * 90 + "   ", "word  " * 50, " a   b " * 40, "x " * 31 + " " * 9 + "y", "tail" + " " * 64, "ab " * 21 + "c  d" + " " * 70 + "e f"]
    many = [t.encode() for t in [*texts()[::3], *spaced, "ﬁne ﬁ " * 40 + "x", "tail ﬁ", "①② x" * 30]]
    got: dict[int, list] = {}
    for number, ids, places, decoded in model.encoded(many):
        got.setdefault(number, []).append((ids, places, decoded))
    for number, text in enumerate(many):
        ids, places = model.align(text)
        parts = got.get(number, [])
        assert [i for p in parts for i in p[0].tolist()] == ids[1:-1].tolist()
        assert b"".join(p[2] for p in parts) == model.decode(ids)
        assert [s for p in parts for s in p[1].tolist()] == places.tolist(), text[:60]


def test_whole_table_against_the_library(spark):
    """Ids, decoded texts and spans of all documents of a small table; byte pieces have no span of their own in the library."""
    library, folder = sentencepiece.SentencePieceProcessor(model_file=PATH), "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, folder).collect()}
    model = PieceModel(open(PATH, "rb").read())
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        pieces, text = library.encode(doc.text or "", return_type="proto").pieces, (doc.text or "").encode()
        row, spans = rows.pop(doc.doc_id), model.spans(text)
        ids = [1, *[p.id for p in pieces], 2]
        assert row.n_tokens == len(ids) and row.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()
        assert row.spans_sha256 == sha256(np.array([s[2:] for s in spans], "<i8").tobytes()).hexdigest()
        assert all((s[2], s[3]) == (p.begin, p.end) for s, p in zip(spans, pieces, strict=True) if s[0] not in model.byte_value)
    assert not rows


def test_runs_of_spaces_cost_what_single_ones_do():
    """A long text with double, leading and trailing spaces against the library, and its time against a plain one's."""
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceModel(open(PATH, "rb").read())
    random.seed(6)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(20_000)]
    plain = " ".join(random.choice(words) for _ in range(500_000))
    spaced = "  " + plain.replace(" ", "  ", 1000) + " \n  "
    best = {}
    for name, text in (("plain", plain), ("spaced", spaced), ("plain", plain), ("spaced", spaced)):
        began = time.process_time()
        ids = np.concatenate([part for _, part, _, _ in model.encoded([text.encode()])])
        best[name] = min(best.get(name, 1e9), time.process_time() - began)
        assert ids.tolist() == library.encode(text)
    assert best["spaced"] <= 1.5 * best["plain"] + 0.5, best


def test_bytes_that_are_no_characters():
    model = PieceModel(open(PATH, "rb").read())
    ids, places = model.align(b"a\xe6\x97b")
    assert model.decode(ids) == "a\ufffd\ufffdb".encode() and places[-1].tolist() == [3, 4]
