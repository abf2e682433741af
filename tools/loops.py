"""Row-at-a-time Python loops over one company after the other, for comparison with the Spark jobs."""

from __future__ import annotations

import datetime
import re
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from creditloom.sources.stand_ins import RAW, STAND_INS, with_clause  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect()
    for r in RAW:
        con.execute(f"create view {r} as select * from '{folder}/{r}.parquet'")
    take = lambda sql: con.execute(with_clause(sql, STAND_INS)).fetchall()

    ledgers: dict[int, list] = {}
    for row in take("SELECT company_id, txn_date, txn_id, debit::DOUBLE, credit::DOUBLE, lower(trim(party)) FROM c_ledger ORDER BY 1, 2, 3"):
        ledgers.setdefault(row[0], []).append(row[1:])
    start, pairs = time.time(), 0
    for rows in ledgers.values():
        debits, credits = [r for r in rows if r[2] > 0], [r for r in rows if r[3] > 0]
        for d in debits:
            last = d[0] + datetime.timedelta(days=3)
            for c in credits:
                if d[0] <= c[0] <= last and d[2] * 0.98 <= c[3] <= d[2] * 1.02 and c[4] == d[4]:
                    pairs += 1
                    break
    print(f"nested loop pairs {pairs} in {time.time() - start:.1f}s")

    chunks: dict[int, list] = {}
    for row in take("SELECT company_id, chunk_id, chunk_text FROM c_chunks"):
        chunks.setdefault(row[0], []).append(row[1:])
    start, kept = time.time(), 0
    for company, question in take("SELECT company_id, question FROM c_questions"):
        asked = set(re.findall("[a-z0-9]+", question.lower()))
        scored = [(len(asked & set(re.findall("[a-z0-9]+", text.lower()))), i) for i, text in chunks.get(company, [])]
        kept += len(sorted([s for s in scored if s[0]], key=lambda s: (-s[0], s[1]))[:5])
    print(f"scan per question {kept} rows in {time.time() - start:.1f}s")


if __name__ == "__main__":
    main()
