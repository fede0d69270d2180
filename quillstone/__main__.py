"""The stages from a shell: python -m quillstone ingest|clean|export FROM TO [options].  Ends with 0 if anything was accepted."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import ordered
from .plans import flows


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillstone")
    stages = out.add_subparsers(dest="stage", required=True)
    for name, said in (("ingest", "raw folders to staged pairs"), ("clean", "staged pairs to de-identified ones"), ("export", "clean pairs to a dataset")):
        stage = stages.add_parser(name, help=said)
        stage.add_argument("source")
        stage.add_argument("out")
        if name != "clean":
            stage.add_argument("--parity", action="store_true", help="the plain rules, without active consent, attested adulthood and audit")
            stage.add_argument("--consents", help="Parquet with consent_ref and revoked")
        if name == "clean":
            stage.add_argument("--allow-no-face", action="store_true")
            stage.add_argument("--crop-top", type=float, default=0.0, metavar="SHARE")
        if name == "export":
            stage.add_argument("--audits", help="Parquet with label and audited")
            stage.add_argument("--val-fraction", type=float, default=0.1)
            stage.add_argument("--seed", type=int, default=42)
    return out


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    try:
        if given.stage == "ingest":
            result = flows.ingest(spark, given.source, given.out, parity=given.parity, consents=read(given.consents))
        elif given.stage == "clean":
            result = flows.clean(spark, given.source, given.out, allow_no_face=given.allow_no_face, crop_top=given.crop_top)
        else:
            result = flows.export(spark, given.source, given.out, audits=read(given.audits), parity=given.parity, consents=read(given.consents), seed=given.seed, fraction=given.val_fraction)
    except ValueError as error:
        print(error)
        return 1
    for row in result.rejects.toLocalIterator():
        print(f"REJECT {row['label']}: {row['reason']}")
    print(f"{given.stage}: {result.accepted.count()} accepted, {result.rejects.count()} rejected -> {given.out}")
    if given.stage == "export":
        counts = ordered.split_counts(result.accepted).first()
        print(f"{counts['n_train']} train, {counts['n_val']} val" + (", too few for more than a smoke test" if counts["too_small"] else ""))
    return 0 if result.ok else 1


if __name__ == "__main__":
    sys.exit(main())
