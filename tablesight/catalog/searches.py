"""Queries that search all column sets of a table: minimal keys, dependencies, constraints, audit trails."""

from __future__ import annotations

from itertools import combinations

from tablesight.catalog.registry import query
from tablesight.operators import claims, keys, lattice, profile

# ---- minimal keys: seven wide columns, and flags of two or three levels that no key of four parts can use ----
WIDE = ["order_no", "batch", "slot", "part_a", "part_b", "part_c", "part_d"]
_FLAGS = [f"flag_{i}" for i in range(33)]


def subsets(columns, largest):
    return [s for size in range(1, largest + 1) for s in combinations(columns, size)]


def _bits(columns, chosen):
    return sum(1 << columns.index(c) for c in chosen)


def _counts(table, columns, largest):
    """Distinct groups of every column set, null as a value: mask, names, n_parts, n."""
    return " union all ".join(
        f"""select {_bits(columns, s)} as mask, '{",".join(s)}' as names, {len(s)} as n_parts, (select count(*) from (select distinct {", ".join(s)} from {table}) q) as n"""
        for s in subsets(columns, largest))


@query("a6_minimal_keys", f"""
with sets as ({_counts("split_orders", WIDE, 4)}),
keys as (select * from sets where n = (select count(*) from split_orders))
select 'orders' as run_id, names as keys, n_parts from keys k
where not exists (select 1 from keys o where o.mask <> k.mask and (o.mask & k.mask) = o.mask)
""", ("split_orders",))
def a6_minimal_keys(tb):
    table = tb.input("split_orders")
    levels, n = lattice.level_counts(profile.cell_histogram(table, "orders"))
    known = lattice.sampled_witnesses(table, table.columns, levels, n)
    return lattice.key_rows(table, "orders", lattice.minimal_keys(table, table.columns, levels, n, known))


LINKED = ["zip", "city", "area", "qty", "line_no", "rate", "flag", "status", "part", "stock"]


@query("a10_functional_dependencies", f"""
with sets as ({_counts("zip_lines", LINKED, 3)}),
total as (select count(*) as n from zip_lines),
sides as (select x.* from sets x where x.n_parts <= 2
  and not exists (select 1 from sets k where (k.mask & x.mask) = k.mask and k.n = (select n from total))
  and not exists (select 1 from sets k where k.n_parts = 1 and (k.mask & x.mask) = k.mask and k.n = 1)
  and (x.n_parts = 1 or not exists (select 1 from sets k where k.n_parts = 1 and (k.mask & x.mask) = k.mask and k.n = x.n)))
select 'lines' as run_id, x.names as determinant, y.names as dependent, x.n_parts, x.n as n_groups
from sides x join sets y on y.n_parts = 1 and y.n > 1 and (x.mask & y.mask) = 0
join sets xy on xy.mask = x.mask + y.mask and xy.n = x.n
where x.n_parts = 1 or not exists (select 1 from sets a join sets ay on ay.mask = a.mask + y.mask
  where a.n_parts = 1 and (a.mask & x.mask) = a.mask and ay.n = a.n)
""", ("zip_lines",))
def a10_functional_dependencies(tb):
    table = tb.input("zip_lines")
    levels, n = lattice.level_counts(profile.cell_histogram(table, "lines"))
    known = lattice.sampled_witnesses(table, table.columns, levels, n)
    keys = lattice.minimal_keys(table, table.columns, levels, n, known, largest=2)
    return lattice.dependency_rows(table, "lines", lattice.functional_dependencies(table, table.columns, levels, n, keys, known))


# ---- constraints among all numeric columns ----
LEDGER = ["order_no", "line_no", "gross", "net", "tax", "qty", "stock", "loss", "used"]


def _claim(name, filled, holds):
    return f"""select '{name}' as "constraint", count(case when {filled} then 1 end) as checked, count(case when {filled} and {holds} then 1 end) as held from ledger"""


_CLAIMS = " union all ".join(
    [_claim(f"{a} <= {b}", f"{a} is not null and {b} is not null", f"{a} <= {b}") for a in LEDGER for b in LEDGER if a != b]
    + [_claim(f"{a} + {b} = {c}", f"{a} is not null and {b} is not null and {c} is not null", f"{a} + {b} = {c}")
       for i, a in enumerate(LEDGER) for b in LEDGER[i + 1:] for c in LEDGER if c not in (a, b)])


@query("a10_deterministic_constraints", f"""
select 'ledger' as run_id, "constraint", checked, cast(1 as double) as held_share, true as deterministic
from ({_CLAIMS}) c where checked > 0 and held = checked
""", ("ledger",))
def a10_deterministic_constraints(tb):
    ledger = tb.input("ledger")
    return claims.deterministic_constraints(ledger, "ledger", LEDGER, ["shipped"], ledger.count())


ENTITIES, TIMES, VERSIONS = ["customer", "record"], ["written", "other"], ["written", "revision"]


@query("a10_audit_signals", """
with runs as (select write_no, written, other,
  max(written) over (order by write_no rows between unbounded preceding and 1 preceding) as w, max(other) over (order by write_no rows between unbounded preceding and 1 preceding) as o from versions),
monotone as (select 'monotone_with_order' as signal, 'write_no' as along, 'written' as "column", count(written) as checked, count(case when written >= coalesce(w, written) then 1 end) as held from runs
  union all select 'monotone_with_order', 'write_no', 'other', count(other), count(case when other >= coalesce(o, other) then 1 end) from runs),
tops as (""" + " union all ".join(
    f"""select '{e}' as along, '{v}' as "column", k, count(*) as n, count(case when ver = top then 1 end) as last from
  (select {e} as k, {v} as ver, max({v}) over (partition by {e}) as top from versions where {e} is not null and {v} is not null) q group by k having count(*) > 1"""
    for e in ENTITIES for v in VERSIONS) + """),
writers as (select 'last_writer' as signal, along, "column", count(*) as checked, count(case when last = 1 then 1 end) as held from tops group by along, "column")
select 'versions' as run_id, signal, along, "column", checked, round(cast(held as double) / checked, 6) as held_share
from (select * from monotone union all select * from writers) s where round(cast(held as double) / checked, 6) >= 0.4
""", ("versions",))
def a10_audit_signals(tb):
    return claims.audit_signals(tb.input("versions"), "versions", ["write_no"], ENTITIES, TIMES, VERSIONS, cut=0.4)


# ---- screening correlations of all levels ----
_FAMILIES = {"refund": ["refund_amt", "refund_reason", "refund_channel", "refund_total", "refund_code"], "depth": ["click_depth", "noise"]}
_SCREENS = ["event_type", "refund_reason", "user_day"]
_DAYS = "select *, case when event_id % 13 > 0 then user_id % 7 end as user_day from "


@query("a10_screening_all_levels", f"""
with e as materialized ({_DAYS} gated_events),
levels as (""" + " union ".join(f"select '{s}' as screen, cast({s} as varchar) as level from e where {s} is not null" for s in _SCREENS) + """),
pairs as (""" + " union all ".join(
    f"""select l.screen, l.level, '{f}' as family_id, corr((cast(e.{s} as varchar) = l.level)::int::double, ({" + ".join(f"({c} is not null)::int" for c in members)})::double) as c
  from levels l, e where l.screen = '{s}' and e.{s} is not null group by l.screen, l.level"""
    for s in _SCREENS for f, members in _FAMILIES.items()) + """)
select 'events' as run_id, screen, level, family_id, round(case when isnan(c) then null else c end, 6) as correlation from pairs
""", ("gated_events",))
def a10_screening_all_levels(tb):
    return keys.all_screening_correlations(tb.sql(_DAYS + "{gated_events}"), "events", _SCREENS, _FAMILIES)
