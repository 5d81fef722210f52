import base64
import hashlib
import io
import json
import zipfile
import zlib

import pytest

from lumenfold import governance
from lumenfold.functions import extract
from lumenfold.operators import quality
from lumenfold.sources import acquire
from lumenfold.specs import ContractError


def document(body=b"", inner=b""):
    return b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog " + inner + b" >>\nendobj\n" + body + b"xref\n0 1\ntrailer\n<< >>\nstartxref\n9\n%%EOF"


def test_names_are_decoded_and_opaque_parts_left_out():
    raw = document(b"2 0 obj << /J#53 (x /JS \\) (/JS) ) /OpenAction 1 0 R >> % /JS\n<2f4a53> endobj\n3 0 obj << >> stream\n/JS /Launch\nendstream endobj\n")
    r = extract.structure(raw)
    assert (r["js_count"], r["openaction_count"], r["launch_count"], r["obfuscation_count"]) == (1, 1, 0, 1)
    assert (r["obj_count"], r["endobj_count"], r["stream_count"], r["endstream_count"]) == (3, 3, 1, 1)
    assert r["indirect_obj_count"] == 1 and r["avg_stream_size"] == len(b"/JS /Launch")
    assert r["header_valid"] == 1 and r["abstain_recommended"] == 0


def test_health_of_damaged_documents():
    assert extract.structure(b"")["abstain_recommended"] == 1
    assert extract.structure(document()[:-5])["invalid_eof"] == 1
    assert extract.structure(b"junk")["invalid_header"] == 1
    assert extract.structure(document(b"4 0 obj << >> stream\nnever ends"))["truncated_structure"] == 1
    assert extract.structure(document(b"5 0 obj ("))["truncated_structure"] == 1


def test_streams_beyond_ten_thousand_count():
    raw = document(b"1 0 obj\nstream\nab\nendstream\nendobj\n" * 10_000 + b"1 0 obj\nstream\n" + b"c" * 20_002 + b"\nendstream\nendobj\n")
    out = extract.structure(raw)
    assert out["stream_count"] >= 10_001 and out["extraction_limit_reached"] == 0 and out["abstain_recommended"] == 0
    sizes = out["avg_stream_size"] * out["stream_count"]
    assert sizes >= 2 * 10_000 + 20_002


def test_bounded_decoding():
    data = b"hello " * 50
    packed = zlib.compress(data)
    assert extract.decode(packed, ("/Fl",)) == data
    assert extract.decode(data.hex().encode() + b">", ("/ASCIIHexDecode",)) == data
    assert extract.decode(base64.a85encode(packed, adobe=True), ("/A85", "/FlateDecode")) == data
    assert extract.decode(bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128]), ("/RL",)) == b"abczzz"
    for bad, chain in ((zlib.compress(b"0" * 10**6), ("/FlateDecode",)), (data, ("/DCTDecode",)), (data, ("/Fl",) * 5), (b"zz", ("/AHx",))):
        with pytest.raises(extract.DecodeError):
            extract.decode(bad, chain)


def test_object_streams():
    body = b"7 0 8 5 null null"
    good = b"<< /Type /ObjStm /N 2 /First 8 /Filter /FlateDecode >> stream\n" + zlib.compress(body) + b"\nendstream"
    bad = b"<< /Type /ObjStm /N 9 /First 4 >> stream\n1 2 \nendstream"
    assert extract.object_streams(good + bad) == {"seen": 2, "valid": 1, "failed": 1, "limit_reached": False}


def test_strings_comments_and_streams_in_each_other():
    c = extract.canonical(b"(a \\) % ( nested ) /JS) /A#42 % (not a text\n<</B<2f/JS>>> (open /JS")
    assert c.text == b"/AB <</B >>" and (c.escapes, c.comments) == (1, 1)
    c = extract.canonical(b"1 0 obj stream\r\n/JS endstreams endstream /K stream\nnever")
    assert c.text == b"1 0 obj stream endstream /K stream" and c.bodies == 2
    found = [x.content(b"stream\nab\r\nendstream stream\n\nendstream") for x in extract.bodies(b"stream\nab\r\nendstream stream\n\nendstream")]
    assert found == [b"ab", b""]


@pytest.mark.parametrize("unit", [b"<< ", b"stream\n", b"(", b"<", b"%", b"/#41", b"endstream ", b">>stream\n", b"/EF<<", b"/Title("])
def test_hostile_documents_take_time_in_proportion(unit):
    import time

    began = time.process_time()
    extract.structure(unit * ((4 << 20) // len(unit)))
    assert time.process_time() - began < 12


def test_metadata_of_the_information_dictionary():
    info = b"7 0 obj\n<< /Title (A \\(small\\) title) /Author <feff00e9> /Producer (x) >>\nendobj\n"
    file = b"8 0 obj << /Type /Filespec /EF << /F 9 0 R >> >> endobj 9 0 obj << /Type /EmbeddedFile /Length 120 >> stream\nx\nendstream endobj\n"
    raw = document(info + file).replace(b"trailer\n<< >>", b"trailer\n<< /Info 7 0 R >>")
    r = extract.structure(raw)
    assert extract.information(raw) == {"/Title": "A (small) title", "/Author": "\u00e9", "/Producer": "x"}
    assert (r["title_chars"], r["avg_embedded_media_size"], r["parse_failure"], r["abstain_recommended"]) == (15, 120, 0, 0)
    assert r["metadata_size"] == len(str(extract.information(raw)))
    assert extract.structure(b"%PDF-1.4 nothing")["recovery_mode"] == 1
    from lumenfold.specs import BASE_NAMES, STATUS

    assert set(BASE_NAMES) | set(STATUS) <= set(extract.FIELDS)


def test_batch_and_single_agree(spark):
    raws = {str(i): document(b"%d 0 obj << /JS >> endobj\n" % i, b"/URI " * i) for i in range(1, 30)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raws.items()] + [("none", None)], "id string, content binary")
    for r in extract.extract(df, "id").collect():
        assert {f: r[f] for f in extract.FIELDS} == extract.structure(raws.get(r["id"], b""))


def test_envelope(spark):
    rows = [(b"",), (None,), (b"x" * 99,), (b"abc",), (b"%PDF-1.4 ...",), (document(),)]
    df = spark.createDataFrame([(i, x and bytearray(x) if x is not None else None) for i, (x,) in enumerate(rows)], "i int, content binary")
    got = [r["v"] for r in df.select("i", quality.envelope(maximum=98).alias("v")).orderBy("i").collect()]
    assert got[:5] == ["empty", "empty", "too_large", "missing_header", "missing_eof"]
    assert df.where("i = 5").select(quality.envelope().alias("v")).first()["v"] == "ok"


def test_sources_are_approved_fetched_and_verified(tmp_path):
    data = b"a,b\n1,2\n"
    good = dict(url="https://example.org/t.csv", sha256=hashlib.sha256(data).hexdigest(), licence="CC0", enabled=True, approved=True, max_bytes=100)
    s = acquire.registry({"t": good})["t"]
    assert acquire.approval_problems(s) == []
    assert "not approved" in acquire.approval_problems(acquire.Source("u"))
    assert acquire.acquire(s, tmp_path, lambda url: io.BytesIO(data)).read_bytes() == data
    for change, sent in ((dict(max_bytes=3), data), ({}, data + b"x"), (dict(approved=False), data)):
        with pytest.raises(ContractError):
            acquire.acquire(acquire.registry({"t": good | change})["t"], tmp_path, lambda url, sent=sent: io.BytesIO(sent))
    with pytest.raises(ContractError):
        acquire.registry({"t": {"colour": 1}})


def test_archives(tmp_path):
    for name, members in (("ok.zip", {"t.csv": "a\n1\n"}), ("evil.zip", {"../t.csv": "a"}), ("two.zip", {"a.csv": "1", "b.csv": "2"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
    path = tmp_path / "ok.zip"
    assert acquire.single_member(path, acquire.digest(path), tmp_path / "out.csv").read_text() == "a\n1\n"
    for bad in ("evil.zip", "two.zip"):
        with pytest.raises(ContractError):
            acquire.single_member(tmp_path / bad, acquire.digest(tmp_path / bad), tmp_path / "x.csv")


def test_seals_sidecars_ledger_and_bundle(tmp_path):
    (tmp_path / "s" / "train").mkdir(parents=True)
    (tmp_path / "s" / "train" / "part.bin").write_bytes(b"1")
    governance.seal(tmp_path / "s", {"rows": 1})
    assert governance.open_partition(tmp_path / "s", "train").endswith("train")
    for f in (lambda: governance.open_partition(tmp_path / "s", "test"), lambda: governance.seal(tmp_path / "s", {})):
        with pytest.raises(ContractError):
            f()
    (tmp_path / "s" / "train" / "part.bin").write_bytes(b"2")
    with pytest.raises(ContractError):
        governance.verify_seal(tmp_path / "s")
    identity = dict.fromkeys(governance.IDENTITY, "x")
    f = tmp_path / "model.bin"
    f.write_bytes(b"m")
    governance.write_sidecar(f, identity)
    assert governance.verify_sidecar(f, identity)["bytes"] == 1
    f.write_bytes(b"n")
    with pytest.raises(ContractError):
        governance.verify_sidecar(f)
    ledger = governance.Ledger(tmp_path / "ledger.json")
    ledger.claim("secret", "final")
    with pytest.raises(ContractError):
        ledger.claim("secret", "again")
    with pytest.raises(ContractError):
        ledger.finish("other", "0")
    ledger.finish("secret", "0" * 64)
    b = governance.Bundle(("a",), (1.0,), 0.0, 0.5, (0.0,), (1.0,), {"id": 1})
    b.save(tmp_path / "b.json")
    assert governance.Bundle.load(tmp_path / "b.json") == b
    changed = json.loads((tmp_path / "b.json").read_text())
    changed["bundle"]["threshold"] = 0.1
    (tmp_path / "b.json").write_text(json.dumps(changed))
    with pytest.raises(ContractError):
        governance.Bundle.load(tmp_path / "b.json")


def test_identities():
    a = governance.experiment_id({"seed": 1, "created_at": "now"}, "d", "c")
    assert a == governance.experiment_id({"seed": 1, "created_at": "later"}, "d", "c") and len(a) == 20
    with pytest.raises(ContractError):
        governance.Config(1, validation_fraction=0.6, test_fraction=0.5)
    first = {"n": 1}
    governance.verify_chain([first, {"previous_sha256": governance.sha256(governance.canonical(first))}])
    with pytest.raises(ContractError):
        governance.verify_chain([first, {}])
    assert governance.markdown([{"a": 0.5, "b": None}], ("a", "b")) == "| a | b |\n|---|---|\n| 0.5000 |  |\n"
