"""Copies of the smallest tables, made empty or dirty."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

CLASHING = ("_r", "_s", "_c", "_k", "n", "at", "origin", "keep_id", "codes", "side", "_b", "_h", "stored", "parent_key", "labels", "listing", "n_tokens", "pack_id", "draw_rank", "usable", "f1", "match")


def make(source: str, target: Path, empty: bool) -> str:
    target.mkdir(parents=True, exist_ok=True)
    for p in Path(source).glob("*.parquet"):
        t = pq.read_table(p)
        if empty:
            t = t.slice(0, 0)
        else:
            cols = {}
            for i, name in enumerate(t.column_names):
                values = t.column(name).to_pylist()
                cols[name] = pa.array([None if (j * 7 + i * 3) % 11 == 0 else v for j, v in enumerate(values)], t.schema.field(name).type)
            t = pa.table(cols)
            t = pa.concat_tables([t, t.slice(0, max(1, len(t) // 5))])  # repeated rows
            for name in CLASHING:
                if name not in t.column_names:
                    t = t.append_column(name, pa.array(["clash"] * len(t)))
        pq.write_table(t, target / p.name)
    return str(target)
