from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lexisift.llm import token_files
from lexisift.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no tokenizer files here")


def read_all(folder):
    """The streams of all files, from their sequences and masks."""
    out = []
    for p in sorted(Path(folder).glob("*.arrow")):
        f = token_files.open_file(str(p))
        parts = [f[k] for k in range(len(f))]
        out.append(np.concatenate([ids[mask] for ids, mask in parts]).tolist())
    return out


def test_round_trip(spark, edge, tmp_path):
    rows = token_files.write_tokens(edge.repartition(3), f"file://{tmp_path}/t", PATH, length=64, batch=4).collect()
    enc = token_files.encoder(PATH)
    want = Counter(tuple(enc.encode_ordinary(r["text"])) for r in edge.collect() if r["text"])
    got = Counter()
    for stream in read_all(f"{tmp_path}/t"):
        doc = []
        for x in stream:
            if x == enc.n_vocab:
                got[tuple(doc)] += 1
                doc = []
            else:
                doc.append(x)
        assert not doc
    assert got == want
    for r in rows:
        ids, mask = token_files.open_file(r["path"])[r["batch"] * 4 + r["row"]]
        assert mask.sum() == r["n_tokens"] and int(ids.astype(np.int64).sum()) == r["id_sum"] and len(ids) == 64
    assert sum(r["n_tokens"] for r in rows) == sum(len(k) * n + n for k, n in want.items())
    held = Counter(i for r in rows for i in set(r["doc_ids"]))
    assert {1, 2, 5, 6, 7, 8, 9, 10, None} == set(held) and not list(Path(f"{tmp_path}/t").glob("*.arrow.*"))


def test_views_are_not_copies(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c " * 500)], "doc_id long, text string")
    token_files.write_tokens(df, f"file://{tmp_path}/t", PATH, length=32).collect()
    (p,) = Path(f"{tmp_path}/t").glob("*.arrow")
    ids, mask = token_files.open_file(str(p))[3]
    for x in (ids, mask):
        assert not x.flags.owndata and not x.flags.writeable
    assert mask.dtype == bool and len(mask) == 32


def test_files_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c " * 500)], "doc_id long, text string")
    rows = token_files.write_tokens(df, f"file://{tmp_path}/t", PATH, length=32)
    (p,) = Path(f"{tmp_path}/t").glob("*.arrow")
    before = p.stat().st_mtime_ns
    assert rows.count() == len(rows.collect()) == len(token_files.open_file(f"file://{p}")) and p.stat().st_mtime_ns == before


def test_other_file_systems(spark, tmp_path, monkeypatch):
    """The mock scheme is a file system in memory; an unknown scheme is refused; nothing lands in a local folder of that name."""
    monkeypatch.chdir(tmp_path)
    df = spark.createDataFrame([(1, "a b c " * 500)], "doc_id long, text string")
    rows = token_files.write_tokens(df, "mock:///tokens", PATH, length=32).collect()
    assert rows and all(r["path"].startswith("mock:///tokens/part-") for r in rows) and not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="no file system"):
        token_files.write_tokens(df, "nowhere://host/tokens", PATH)
    with pytest.raises(ValueError, match="larger than a vocabulary"):
        monkeypatch.setattr(token_files, "MAX_VOCABULARY", 10)
        token_files.write_tokens(df, f"file://{tmp_path}/t", PATH)


def test_empty(spark, empty, tmp_path):
    assert token_files.write_tokens(empty, f"file://{tmp_path}/t", PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert token_files.write_tokens(nothing, f"file://{tmp_path}/t", PATH).count() == 0 and not Path(f"{tmp_path}/t").exists()
