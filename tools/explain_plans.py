"""Write the formatted physical plans of chosen queries to docs/PLANS.md.

usage: python tools/explain_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticketlens.plans.catalog import load_all  # noqa: E402
from ticketlens.session import local_session  # noqa: E402

DEFAULT = ["A6_A7_A8_project_overview", "S1_S3_read_issues_file", "N7_link_features", "A16_gini", "J2_merge_task_project"]


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or DEFAULT
    spark = local_session(8)
    reg = load_all()
    out = ["# Physical plans of selected queries", "",
           f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local[8], AQE on; final plans are chosen at run time).", ""]
    for n in names:
        df = reg[n].build(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        out += [f"## {n}", "", reg[n].doc, "", "```", buf.getvalue().strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
