"""Model files in both number types, read in parts, and what is refused."""

import json
import struct

import numpy as np
import pytest

from tracemill.functions import wordpiece
from tracemill.sources import models


def _write(path, values, kind="F32", name="embeddings", **wrong):
    data = values.astype({"F16": "<f2", "F32": "<f4"}.get(kind, "<f4")).tobytes()
    info = {"dtype": kind, "shape": list(values.shape), "data_offsets": [8, 8 + len(data)], **wrong}
    header = json.dumps({"__metadata__": {"a": "b"}, name: info}).encode()
    path.write_bytes(struct.pack("<Q", len(header)) + header + b"\0" * 8 + data)
    return str(path)


@pytest.mark.parametrize("kind", ["F16", "F32"])
def test_vectors(spark, tmp_path, kind):
    values = np.random.default_rng(3).normal(size=(1000, 24)).astype("f4")
    values[5] = 0
    values[6, :3] = [127, 0.5, -0.5]
    values[6, 3:] = 0
    values[7] = 6e-8  # below the normal numbers of 16 bits
    path = _write(tmp_path / "m.safetensors", values, kind)
    df = models.token_vectors(spark, path, rows=300)
    rows = df.orderBy("token").collect()
    assert df.rdd.getNumPartitions() == 4 and [r.token for r in rows] == list(range(1000))
    stored = values.astype("<f2" if kind == "F16" else "<f4").astype("f4")
    for r, want in zip(rows, stored, strict=True):
        top = max(abs(float(x)) for x in want)
        assert r.scale == (np.float32(top) / np.float32(127) if top else 1.0)
        assert all(abs(float(x) / r.scale - q) <= 0.5001 for x, q in zip(want, r.q, strict=True))
    assert rows[5].scale == 1.0 and set(rows[5].q) == {0} and list(rows[6].q)[:4] == [127, 1, -1, 0] and set(rows[7].q) == {127}
    assert models.token_vectors(spark, _write(tmp_path / "e.safetensors", values[:0], kind)).count() == 0


def test_refused(tmp_path):
    values = np.ones((3, 4))
    for n, wrong in enumerate([{"kind": "BF16"}, {"name": "other"}, {"shape": [12]}, {"shape": [3, 5]}, {"data_offsets": [0, 48_000]}]):
        with pytest.raises(ValueError):
            models.matrix(_write(tmp_path / f"{n}", values, **wrong))
    for name, data in {"empty": b"", "short": b"\1\0", "long": struct.pack("<Q", 10**9) + b"{}", "json": struct.pack("<Q", 2) + b"{x"}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            models.matrix(str(tmp_path / name))


def test_model(spark, tmp_path):
    vocab = {"the": 0, "car": 1, "##s": 2, "语": 3}
    tokenizer = {"model": {"type": "WordPiece", "vocab": vocab}, "normalizer": {"type": "BertNormalizer", "lowercase": True}, "more": [1]}
    (tmp_path / "tokenizer.json").write_text(json.dumps(tokenizer, indent=1))
    _write(tmp_path / "model.safetensors", np.eye(4, 6), "F16")
    known, vectors = models.model(spark, str(tmp_path))
    assert known == vocab
    texts = spark.createDataFrame([(1, "The CARS"), (2, "语"), (3, "zzz"), (4, ""), (5, None)], "id int, text string")
    got = {r.id: r.embedding for r in wordpiece.embedded(wordpiece.encoded(texts, "id", "text", known), vectors).collect()}
    assert set(got) == {1, 2} and np.allclose(got[1], np.array([1, 1, 1, 0, 0, 0]) / 3**0.5) and np.allclose(got[2], np.eye(6)[3])
    _write(tmp_path / "model.safetensors", np.eye(5, 6))
    with pytest.raises(ValueError, match="4 pieces for 5 vectors"):
        models.model(spark, str(tmp_path))
    tokenizer["normalizer"]["lowercase"] = False
    (tmp_path / "tokenizer.json").write_text(json.dumps(tokenizer))
    with pytest.raises(ValueError):
        models.model(spark, str(tmp_path))
