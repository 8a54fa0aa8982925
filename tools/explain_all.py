"""Write the formatted physical plan of every registered golden query.

usage: python tools/explain_all.py <sf_dir> <out_dir> [name ...]

Plans are taken over the materialised golden record (the production shape)
and written as ``<out_dir>/<name>.txt`` for review (exchanges, broadcasts,
pushed filters, read schemas, window partitions).
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerframe import registry  # noqa: E402
from ledgerframe.plans import golden as G  # noqa: E402
from ledgerframe.session import build_session, checkpoint_dir  # noqa: E402


def main():
    sf_dir, out_dir, names = sys.argv[1], sys.argv[2], sys.argv[3:]
    os.makedirs(out_dir, exist_ok=True)
    spark = build_session()
    if not checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerframe-tool-"))
    g = G.materialize(G.golden_from_tables(spark, sf_dir))
    for name in names or list(registry.GOLDEN_QUERIES):
        df = registry.GOLDEN_QUERIES[name](g)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(plan)
        print(name, plan.count("Exchange"), "exchanges")
    spark.stop()


if __name__ == "__main__":
    main()
