"""`python -m kmerlake`: the analyses over files, as tab-separated text."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Sequence

from pyspark.sql import SparkSession

from kmerlake import api
from kmerlake.sources import shared, tsv


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerlake", description="k-mer containment and read classification on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, within=commands, **how) -> argparse.ArgumentParser:
        p = within.add_parser(name, **how)
        p.add_argument("-o", "--output", default="-", help="a file, or - for standard output")
        return p

    def kmers(p: argparse.ArgumentParser) -> None:
        p.add_argument("-k", type=int, default=31)
        p.add_argument("-s", type=int, default=9)
        p.add_argument("--order", choices=("md5", "mix", "rolling", "lex"))

    def targets(p: argparse.ArgumentParser) -> None:
        kmers(p)
        p.add_argument("-i", "--individual", action="store_true", help="each record of a file is a target")
        p.add_argument("-f", "--fraction", type=float)
        p.add_argument("-b", "--background", action="append", default=[])

    def reads(p: argparse.ArgumentParser) -> None:
        p.add_argument("samples", nargs="+", help="files or folders; - for standard input")
        p.add_argument("-n", "--names", type=lambda x: x.split(","))
        p.add_argument("-l", "--limit", help="bases of each sample, such as 10M")
        p.add_argument("-d", "--discriminatory", action="store_true")

    query = command("query", help="how much of each target each sample has")
    query.add_argument("targets", help="a file, a folder or an index")
    targets(query)
    reads(query)
    query.add_argument("-a", "--thresholds", type=lambda x: [int(t) for t in x.split(",") if t], default=[10])
    query.add_argument("-c", "--confidence", action="store_true")
    query.add_argument("--no-total", action="store_true")
    query.add_argument("--sort", choices=("containment", "target", "sample", "input"), default="containment")
    dump = command("dump", help="the k-mers of targets")
    dump.add_argument("targets")
    targets(dump)
    for name, text in (("classify", "the group of each read"), ("lenhist", "read lengths by group")):
        p = command(name, help=text)
        p.add_argument("groups", help="a folder or an index" + ("; - for no groups" if name == "lenhist" else ""))
        kmers(p)
        reads(p)
        p.add_argument("--abs-threshold", type=int, default=1)
        p.add_argument("--rel-threshold", type=float, default=0.0)
        if name == "classify":
            p.add_argument("--per-seq", action="store_true")
    index = commands.add_parser("index", help="prebuilt k-mer tables").add_subparsers(dest="index", required=True)
    for name in ("build-query", "build-classify"):
        p = index.add_parser(name)
        p.add_argument("input")
        p.add_argument("path")
        p.add_argument("--form", choices=("parquet", "packed", "buckets"), default="parquet")
        (targets if name == "build-query" else kmers)(p)
        if name == "build-query":
            p.add_argument("--positions", action="store_true")
    info = command("info", index)
    info.add_argument("path")
    return top


def _table(df) -> Iterable[str]:
    """Any result as lines. Rows come by partitions, not all at once."""
    yield "\t".join(df.columns)
    for r in df.toLocalIterator():
        yield "\t".join("" if v is None else str(v) for v in r)


def lines(spark: SparkSession, a: argparse.Namespace) -> Iterable[str]:
    if a.command == "query":
        out = api.query(spark, a.targets, a.samples, k=a.k, s=a.s, individual=a.individual, confidence=a.confidence, discriminatory=a.discriminatory, fraction=a.fraction, thresholds=a.thresholds, background=a.background, limit=a.limit, names=a.names, order=a.order)
        return tsv.report_lines(out, a.thresholds, a.confidence, not a.no_total, a.sort, api.sample_order(a.samples, a.names))
    if a.command == "dump":
        return _table(api.dump_syncmers(spark, a.targets, k=a.k, s=a.s, individual=a.individual, fraction=a.fraction, background=a.background, order=a.order))
    if a.command in ("classify", "lenhist"):
        common = {"k": a.k, "s": a.s, "discriminatory": a.discriminatory, "abs_threshold": a.abs_threshold, "rel_threshold": a.rel_threshold, "limit": a.limit, "names": a.names, "order": a.order}
        if a.command == "lenhist":
            return _table(api.lenhist(spark, a.groups, a.samples, **common).orderBy("sample", "group", "length"))
        out = api.classify(spark, a.groups, a.samples, per_seq=a.per_seq, **common)
        return _table(out) if a.per_seq else tsv.summary_lines(out, api.sample_order(a.samples, a.names))
    if a.index == "build-query":
        api.build_query_index(spark, a.input, a.path, k=a.k, s=a.s, individual=a.individual, positions=a.positions, fraction=1.0 if a.fraction is None else a.fraction, background=a.background, order=a.order, form=a.form)
    elif a.index == "build-classify":
        api.build_classify_index(spark, a.input, a.path, k=a.k, s=a.s, order=a.order, form=a.form)
    return _table(api.index_info(spark, a.path))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("kmerlake").getOrCreate()
    try:
        found = lines(spark, a)
        if getattr(a, "output", "-") == "-":
            for line in found:
                print(line)
        else:
            with open(a.output, "w") as out:
                out.writelines(f"{line}\n" for line in found)
        return 0
    except (ValueError, OSError) as e:
        print(f"kmerlake: {e}", file=sys.stderr)
        return 1
    finally:
        shared.release(spark)
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
