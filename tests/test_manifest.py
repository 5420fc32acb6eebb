"""vf_manifest over all tables, and against a stored manifest."""

import hashlib
import json
import pathlib

from assaylake import plans

SF = pathlib.Path("/root/testdata/sf0.001")


def test_every_file_is_listed(spark):
    want = {(str(p.relative_to(SF)), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in SF.rglob("*.parquet") if p.is_file()}
    assert {(r.file, r.bytes, r.sha256) for r in plans.QUERIES["vf_manifest"](spark, str(SF)).collect()} == want


def test_stale_missing_and_unlisted(spark, tmp_path):
    for name in ("same", "stale", "more"):
        spark.range(3).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    line = lambda n, x: json.dumps({"file": f"{n}.parquet", "bytes": len(x), "sha256": hashlib.sha256(x).hexdigest()})
    raw = (tmp_path / "same.parquet").read_bytes()
    (tmp_path / "manifest.json").write_text("\n".join([line("same", raw), line("stale", raw[:-1] + b"?"), line("gone", raw)]))
    got = {r.file: r.status for r in plans.QUERIES["vf_manifest"](spark, str(tmp_path)).collect()}
    assert got == {"same.parquet": "same", "stale.parquet": "stale", "gone.parquet": "missing", "more.parquet": "unlisted"}
