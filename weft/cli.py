"""python -m weft.cli inspect|stats|health|diff: reports over tensor files.

Exit status: 0 fine, 1 an error, 2 health found errors (with --strict also warnings) or a bad command line.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from weft.operators import diff as diffs
from weft.operators import health as healths
from weft.operators import stats as statistics
from weft.plans import render
from weft.sources.headers import FormatError
from weft.sources.storage import read_header
from weft.sources.tensors import TENSORS, tensor_rows


def _bins(text: str) -> int:
    n = int(text)
    if not 1 <= n <= 1000:
        raise argparse.ArgumentTypeError("must be from 1 to 1000")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weft")
    p.add_argument("--threads", type=int, help="local worker threads (default: one per CPU); results are the same for any number")
    p.add_argument("--scalar", action="store_true", help="accepted; values are computed the same way with and without it")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("inspect")
    one.add_argument("file")
    two = sub.add_parser("stats")
    two.add_argument("file")
    two.add_argument("--filter")
    two.add_argument("--histogram", action="store_true")
    two.add_argument("--bins", type=_bins, default=16)
    three, t = sub.add_parser("health"), healths.Thresholds()
    three.add_argument("file")
    three.add_argument("--filter")
    three.add_argument("--max-abs", type=float, default=t.max_abs)
    three.add_argument("--max-zero-fraction", type=float, default=t.max_zero_fraction)
    three.add_argument("--max-dead-row-fraction", type=float, default=t.max_dead_row_fraction)
    three.add_argument("--row-norm-ratio", type=float, default=t.row_norm_ratio)
    three.add_argument("--strict", action="store_true")
    four = sub.add_parser("diff")
    four.add_argument("a")
    four.add_argument("b")
    four.add_argument("--strip-prefix", action="append", default=[])
    four.add_argument("--top", type=int, default=20)
    return p


def _tensors(spark: SparkSession, path: str, text: str | None = None) -> tuple[DataFrame, str]:
    try:
        header, _, _ = read_header(path)
    except FormatError as e:
        raise FormatError(str(e) if str(e).startswith("cannot open") else f"cannot parse {path}: {e}") from None
    rows = [r for r in tensor_rows(path) if text is None or text in r[3]]
    return spark.createDataFrame(rows, TENSORS), f"{path} ({header.format}, {len(rows)} tensors)"


def report(args: argparse.Namespace, spark: SparkSession | None) -> tuple[str, int]:
    """The text of a command and its exit status."""
    if args.command == "inspect":
        try:
            return render.inspect(args.file, read_header(args.file)[0]), 0
        except FormatError as e:
            kind = "cannot inspect"
            raise FormatError(str(e) if str(e).startswith("cannot open") else f"{kind} {args.file}: {e}") from None
    if args.command == "diff":
        (a, said_a), (b, said_b) = _tensors(spark, args.a), _tensors(spark, args.b)
        got = diffs.compare(a, b, tuple(args.strip_prefix)).cache()
        return f"A: {said_a}\nB: {said_b}\n" + render.diff(got.collect(), diffs.overall(got).first(), args.top), 0
    tensors, said = _tensors(spark, args.file, args.filter)
    sums = statistics.summaries(tensors).cache()
    rows = sums.orderBy("tensor_pos").collect()
    if args.command == "stats":
        out = f"File: {said}; kernels: vectorised; threads: {spark.sparkContext.defaultParallelism}\n" + render.stats(rows, statistics.total(sums).first())
        if args.histogram:
            by: dict[int, list] = {}
            for r in statistics.histograms(sums, args.bins).orderBy("tensor_pos", "bin").collect():
                by.setdefault(r["tensor_pos"], []).append(r)
            out += "".join(f"\nHistogram of {render.quoted(b[0]['name'])} (finite values):\n{render.histogram(b)}" for b in by.values())
        return out, 0
    t = healths.Thresholds(args.max_abs, args.max_zero_fraction, args.max_dead_row_fraction, args.row_norm_ratio)
    found = healths.check(sums, t).collect()
    skipped = [r for r in rows if not r["dtype"]]
    bad = sum(f["severity"] == "ERROR" or args.strict and f["severity"] == "WARN" for f in found)
    return f"File: {said}\n" + render.health(found, skipped, len(rows) - len(skipped), t), 2 if bad else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.threads is not None and args.threads < 1:
            raise FormatError("--threads must be at least 1")
        if spark is None and args.command != "inspect":
            spark = SparkSession.builder.master(f"local[{args.threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
            spark.sparkContext.setLogLevel("ERROR")
        text, status = report(args, spark)
        sys.stdout.write(text)
        sys.stdout.flush()
        return status
    except BrokenPipeError:
        return 0
    except (FormatError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
