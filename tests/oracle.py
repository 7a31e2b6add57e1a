"""Run a query and its SQL side by side: column names, kinds of types down to the fields of structs, and values."""

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.9g}"
    if isinstance(x, dict):
        return {k: value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{x:.9g}" if abs(x) < 10**8 else str(x)
    return x if isinstance(x, str) else str(x)


def kind(t):
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return [kind(t.value_type)]
    if pa.types.is_struct(t):
        return {f.name: kind(f.type) for f in t}
    if pa.types.is_map(t):
        return ("map", kind(t.key_type), kind(t.item_type))
    for name in ("string", "boolean", "binary", "null"):
        if getattr(pa.types, f"is_{name}")(t) or (name in ("string", "binary") and getattr(pa.types, f"is_large_{name}")(t)):
            return name
    if pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_decimal(t):
        return "number"
    return str(t)


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(sql).to_arrow_table(), query(spark, SF).toArrow()
    assert sorted(want.column_names) == sorted(got.column_names)
    order = sorted(want.column_names)
    assert {c: kind(got.schema.field(c).type) for c in order} == {c: kind(want.schema.field(c).type) for c in order}
    rows = lambda t: sorted(repr([value(r[c]) for c in order]) for r in t.to_pylist())
    a, b = rows(got), rows(want)
    assert a == b, next(((x, y) for x, y in zip(a, b, strict=False) if x != y), (len(a), len(b)))
