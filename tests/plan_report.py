"""Write PLANS.md: the executed physical plan shape of the headline queries.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import collections
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

QUERIES = ["a01_total_umis", "a05_classic", "f01b_matrix_follows", "f12_not_in_list", "j01_annotate_cells",
           "w01_barcode_ranks", "t07_tag_counts", "t05_corrected_match", "e05_loglik_multinomial",
           "e06_monte_carlo_pvalues", "p03_categorical_summary", "k05_wide_matrix"]
KEYS = ("Scan", "Join", "Exchange", "Aggregate", "Window", "WindowGroupLimit", "MapInPandas", "Sort",
        "Subquery", "Expand", "Generate")


def main() -> None:
    from cellgrid.session import local_session
    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    out = ["# Physical plans of the headline queries",
           "",
           f"Generated by `python tests/plan_report.py {sf_dir}` after running each query (final adaptive plans).",
           "Operator counts, then scans with their pruned schema and pushed filters.",
           ""]
    for name in QUERIES:
        df = E.queries()[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = collections.Counter()
        for line in plan.splitlines():
            m = re.match(r"^[\s:+\-|]*(\*\(\d+\)\s*)?([A-Za-z]+)", line)
            if m and any(k in m.group(2) for k in KEYS):
                ops[m.group(2)] += 1
        out.append(f"## {name}")
        out.append("")
        out.append(", ".join(f"{k} × {v}" for k, v in sorted(ops.items())))
        out.append("")
        for line in plan.splitlines():
            if "FileScan" in line or "Scan ExistingRDD" in line:
                scan = re.sub(r"Location: [^,]*\[[^\]]*\]", "Location: …", line.strip(" :+-|"))
                scan = re.sub(r"#\d+L?", "", scan)
                out.append(f"* `{scan[:400]}`")
        out.append("")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
