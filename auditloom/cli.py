"""Command line: prior dumps, internal and external audits, extraction.

    python -m auditloom.cli prior --out dump --tables 100 --rows 200 --features 5
    python -m auditloom.cli extract --rows rows.parquet --features 4 --out signals
    python -m auditloom.cli internal --target t.parquet --blind b.parquet --scopes ALL no:ctx --out internal
    python -m auditloom.cli external --target t.parquet --blind b.parquet --out external
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import audit, predict, signals
from auditloom.plans import extract
from auditloom.sinks import tables, writers
from auditloom.sources import readers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="auditloom")
    commands = parser.add_subparsers(dest="command", required=True)
    prior = commands.add_parser("prior", help="write random tables")
    for name, default in (("tables", 100), ("rows", 200), ("features", 5), ("classes", 2), ("seed", 0)):
        prior.add_argument(f"--{name}", type=int, default=default)
    prior.add_argument("--prior", choices=("linear", "mlp", "steps"), default="linear")
    prior.add_argument("--pad-rows", type=int)
    prior.add_argument("--pad-features", type=int)
    probe = commands.add_parser("extract", help="the signals of datasets (dataset_id, row_id, role, x, y)")
    probe.add_argument("--rows", required=True)
    probe.add_argument("--features", type=int, required=True)
    probe.add_argument("--context-cap", type=int)
    probe.add_argument("--predictor", default="auditloom.plans.extract.NaiveBayes")
    for name in ("internal", "external"):
        one = commands.add_parser(name, help=f"the {name} audit of a pool")
        one.add_argument("--target", required=True, help="signal table of the audited model")
        one.add_argument("--blind", required=True, help="signal table of a model that cannot know the datasets")
        one.add_argument("--label", default="label")
        if name == "internal":
            one.add_argument("--scopes", nargs="+", default=["ALL"])
            one.add_argument("--kinds", nargs="+", default=["lr", "trees"])
            one.add_argument("--fine", action="store_true", help="the finer grid of column counts")
            one.add_argument("--replicates", type=int, default=2000)
        else:
            one.add_argument("--draws", type=int, default=10)
            one.add_argument("--trees", type=int, default=200)
    for one in commands.choices.values():
        one.add_argument("--out", required=True)
    return parser


def _pool(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    read = lambda path: readers.signal_tables(spark, [path])
    return signals.align(read(args.target), read(args.blind), args.label).persist()  # read by ranks, fits and folds


def _names(pool: DataFrame, scope: str) -> list[str]:
    return [r["signal"] for r in pool.select("signal", "family").distinct().where(signals.in_scope(scope)).orderBy("signal").collect()]  # one row per signal


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.command == "prior":
        dump = readers.generated(spark, args.tables, args.rows, args.features, args.classes, args.seed, args.prior)
        if args.pad_rows or args.pad_features:
            dump = writers.padded(dump, args.pad_rows or args.rows, args.pad_features or args.features)
        dump.write.mode("overwrite").parquet(args.out)
        return f"{args.tables} tables in {args.out}"
    if args.command == "extract":
        out = extract.extract(spark.read.parquet(args.rows), predict.imported(args.predictor), args.features, args.context_cap)
        out.write.mode("overwrite").parquet(args.out)
        return f"signals in {args.out}"
    pool = _pool(spark, args)
    if args.command == "internal":
        cells = audit.internal(pool, {s: _names(pool, s) for s in args.scopes}, args.kinds, replicates=args.replicates, ks=audit.K_GRID_FINE if args.fine else audit.K_GRID)
        shown = cells.withColumn("label", F.col("scope")).withColumnRenamed("k_star", "K").withColumn("target_sd", F.lit(None).cast("double")).withColumn("blind_sd", F.lit(None).cast("double"))
        tables.audit_json(shown.withColumn("pool", F.lit("pool")).drop("label"), {"kinds": args.kinds}).write.mode("overwrite").text(args.out)
        return tables.internal_table(shown.orderBy("scope", "kind"))
    kinds = pool.select("signal", "family").distinct()
    arms = {r["arm"]: _names(pool, r["arm"]) for r in signals.arms(kinds).collect()}
    parts = [audit.evaluate(audit.external(pool, arms, args.draws, on, trees=args.trees)).withColumn("scheme", F.lit(s)) for s, on in zip(tables.SCHEMES, (False, True), strict=True)]
    cells = parts[0].unionByName(parts[1]).persist()
    cells.write.mode("overwrite").json(args.out)
    return tables.external_table(cells.withColumn("label", F.concat_ws(" ", "arm", "scheme")).orderBy("arm", "scheme"))


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    print(run(SparkSession.builder.appName("auditloom").getOrCreate(), args))


if __name__ == "__main__":
    main()
