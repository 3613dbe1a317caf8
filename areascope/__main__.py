"""Command line: the two batch programs of the original, on Spark.

  python -m areascope clean --feeds /data/feeds --out /data/run      # bio/, demo/, enrol/ CSV folders
  python -m areascope clean --tables /root/testdata/sf0.01 --out /data/run
  python -m areascope model --out /data/run                           # reads /data/run/master

``clean`` writes ``master`` (Parquet) and the three cleaned monthly feeds;
``model`` writes ``outputs/`` (five tables), ``ml_metadata`` (JSON) and
``models``. On a cluster leave ``--master`` unset (spark-submit decides) and
set ``spark.checkpoint.dir`` to a shared folder.
"""

from __future__ import annotations

import argparse
import json

from . import constants as K
from .operators import master as MA
from .plans import runs as RU
from .session import get_session
from .sources import scan_feed
from .sources import testdata as TD
from .sources.sinks import write_table


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="areascope")
    ap.add_argument("command", choices=["clean", "model"])
    ap.add_argument("--out", required=True, help="run folder (shared storage on a cluster)")
    ap.add_argument("--feeds", help="folder with bio/, demo/, enrol/ CSV feed folders")
    ap.add_argument("--tables", help="folder with the TPC-H-style test tables instead of feeds")
    ap.add_argument("--master", help="Spark master, e.g. local[8]; unset on a cluster")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"], help="result table format")
    ap.add_argument("--n-init", type=int, default=K.KMEANS_N_INIT, help="k-means seeds per k")
    ap.add_argument("--trees", type=int, default=K.FOREST_TREES, help="isolation-forest trees")
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    out = args.out.rstrip("/")
    if args.command == "clean":
        if args.tables:
            raw, valid = TD.raw_feeds(spark, args.tables), TD.valid_states(spark, args.tables)
        elif args.feeds:
            raw, valid = {f: scan_feed(spark, f"{args.feeds.rstrip('/')}/{f}", f) for f in MA.FEEDS}, None
        else:
            ap.error("clean needs --feeds or --tables")
        tables = RU.cleaning_run(raw, valid, path=f"{out}/master")
        for f in MA.FEEDS:
            write_table(tables[f], f"{out}/{f}_cleaned", fmt=args.format)
        print(json.dumps({"master": f"{out}/master", "rows": tables["master"].count()}))
    else:
        run = RU.model_run(spark.read.parquet(f"{out}/master"), n_init=args.n_init, n_trees=args.trees)
        RU.write_model_outputs(run, out, fmt=args.format)
        print(json.dumps({"best_k": run.best_k, "silhouettes": run.silhouettes, "stages": run.stage_seconds}))


if __name__ == "__main__":
    main()
