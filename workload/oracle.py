"""SQL for every registered query, written step by step the plain way.

Joins come before keep-first, each summary is a pass of its own, and medians use the
engine's aggregate, so that the plans, which do it otherwise, are really checked.
"""

from __future__ import annotations

COPY_OFFSET = 1_000_000_000_000

VIEWS = {
    "parcel": """
        select c_custkey as objectid, concat_ws(' ', c_custkey, n_name) as fulladdr, c_name as owner_1,
            cast(nullif(c_custkey, 42) as varchar) as pin,
            cast(c_custkey // 10 as varchar) as block, cast(c_custkey % 10 as varchar) as lot,
            case when n_name = 'NATION_3' then 'N' else '' end || cast(c_custkey % 24 as varchar) as ward,
            cast(nullif(c_custkey % 3, 0) as varchar) as section,
            case when c_acctbal < 0 then 'Y' else 'N' end as no_imprv,
            case when c_custkey % 500 = 11 then null when c_custkey % 7 = 0 then 'Y' else 'N' end as vacind,
            nullif(n_name, 'NATION_7') as neighborhood,
            case when c_custkey % 50 <> 0 then c_mktsegment end as council_district,
            nullif(r_name, 'AFRICA') as csa
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "lot": """
        select c_custkey as k, c_custkey % 1000 * 10.0 as x0, c_custkey // 1000 * 10.0 as y0,
            c_custkey % 5 + 4.0 as w,
            case when c_custkey % 300 = 7 then 0.0 else c_custkey % 3 + 4.0 end as h,
            case when c_custkey % 4 = 0 and c_custkey % 300 <> 7 then 1.0 else 0.0 end as hole
        from customer where c_custkey % 200 <> 9""",
    "centre": """
        select k,
            case when h = 0 then x0 + w / 2 else (w * h * (x0 + w / 2) - hole * (x0 + 1.5)) / (w * h - hole) end as x,
            case when h = 0 then y0 else (w * h * (y0 + h / 2) - hole * (y0 + 1.5)) / (w * h - hole) end as y
        from lot""",
    "parcel_dup": f"""
        select * from parcel
        union all
        select * replace (objectid + {COPY_OFFSET} as objectid, null as csa) from parcel where objectid % 10 = 0""",
    "result": """
        select o_orderkey as adv_number,
            cast(nullif(case when o_custkey % 13 = 0 then o_custkey + 50000000 else o_custkey end, 42) as varchar) as pin,
            cast(greatest(1995, least(2001, year(o_orderdate))) as integer) as auction_year,
            cast(greatest(1995, least(2001, year(o_orderdate))) - 1 as integer) as tax_year,
            case when o_orderkey % 2 = 0 then 'certificate_sale' else 'assignment_sale' end as auction_type,
            case when o_orderstatus = 'F' then o_orderpriority end as removed_because,
            case when o_orderstatus = 'F' then 'Y' else 'N' end as removed,
            case when o_orderstatus = 'F' then cast(o_orderdate as date) end as removed_date,
            case when o_orderstatus = 'O' then 'B' || cast(o_custkey % 97 as varchar) end as winning_bidder_name,
            case when o_orderkey % 5000 <> 7 then o_totalprice end as lien_amount,
            round(o_totalprice * 10, 2) as assessed_value,
            case when o_orderstatus = 'O' then round(o_totalprice * 3, 2) end as winning_bid,
            cast(o_custkey // 10 as varchar) as block, cast(o_custkey % 10 as varchar) as lot,
            case when o_custkey % 13 = 0 then '99' else cast(o_custkey % 24 as varchar) end as ward,
            case when year(o_orderdate) < 2001 then cast(o_orderkey % 13 as integer) end as num_bids,
            case o_orderkey % 3 when 0 then 'Y' when 1 then 'N' end as homestead,
            case when o_orderkey % 4 = 0 then '1' when o_orderkey % 4 < 3 then '0' end as owner_occupied
        from orders""",
    "advertised": """
        select l_orderkey as adv_number, l_linenumber as line_number, l_partkey as part_key,
            l_suppkey as supplier_key,
            cast(o_custkey // 10 as varchar) as block, cast(o_custkey % 10 as varchar) as lot,
            case when o_custkey % 13 = 0 then '99' else cast(o_custkey % 24 as varchar) end as ward,
            cast(nullif(o_custkey % 3, 0) as varchar) as section,
            case when o_custkey not in (3, 103) then l_extendedprice end as lien_amount,
            round(l_extendedprice * 10, 2) as assessment,
            case when l_linenumber = 7 then null when l_returnflag = 'A' then 'D'
                 when l_returnflag = 'R' then 'H' else 'N' end as occupied
        from lineitem join orders on l_orderkey = o_orderkey""",
    "sale_index": """
        select cast(y as integer) as auction_year, cast(y - 1 as integer) as tax_year, k.kind as auction_type,
            y || k.label as auction_label, make_date(y, 5, 13) as auction_date
        from range(1995, 2002) as years(y),
            (values ('certificate_sale', ' Certificate Sale'), ('assignment_sale', ' Assignment Sale')) k(kind, label)""",
    "history_joined": """
        select r.* exclude (block, lot, ward, owner_occupied),
            p.* exclude (pin),
            row_number() over (
                partition by r.pin, r.auction_year
                order by r.adv_number, p.objectid nulls last) as place
        from result r left join parcel_dup p on r.pin is not distinct from p.pin
        where r.auction_year < 2001""",
    "history": "select * exclude (place) from history_joined where place = 1",
    "latest_joined": """
        select r.* exclude (pin, homestead, num_bids),
            p.* exclude (block, lot, ward, section),
            row_number() over (
                partition by r.adv_number
                order by p.csa nulls last, r.block, r.lot, r.ward, p.objectid nulls last) as place
        from result r left join parcel_dup p on r.block is not distinct from p.block
            and r.lot is not distinct from p.lot and r.ward is not distinct from p.ward
        where r.auction_year = 2001""",
    "latest": "select * exclude (place) from latest_joined where place = 1",
    "combined": """
        select * from history where auction_type = 'certificate_sale'
        union all by name
        select * from latest""",
    "advertised_joined": """
        select a.*, p.* exclude (block, lot, ward, section),
            row_number() over (
                partition by a.block, a.lot, a.ward, a.section
                order by a.adv_number, a.line_number, a.part_key, a.supplier_key, a.assessment,
                    a.occupied nulls last, p.objectid nulls last) as place
        from advertised a left join parcel p on a.block is not distinct from p.block
            and a.lot is not distinct from p.lot and a.ward is not distinct from p.ward
            and a.section is not distinct from p.section""",
    "advertised_kept": "select * exclude (place) from advertised_joined where place = 1",
    "area_count": """
        select coalesce(neighborhood, csa, council_district, 'Unknown') as area,
            cast(count(*) as bigint) as num_properties,
            case when grouping(neighborhood) = 0 then 'neighborhood'
                 when grouping(csa) = 0 then 'csa' else 'council_district' end as type
        from parcel group by grouping sets ((neighborhood), (csa), (council_district))""",
    "area_year": """
        select area, type, auction_year from area_count,
            (select distinct auction_year from sale_index)""",
}

# Direct and indirect inputs of each view, in the order they must be stated.
NEEDS = {
    "centre": ["lot"],
    "parcel_dup": ["parcel"],
    "history_joined": ["parcel_dup", "result"],
    "history": ["history_joined"],
    "latest_joined": ["parcel_dup", "result"],
    "latest": ["latest_joined"],
    "combined": ["history", "latest"],
    "advertised_joined": ["parcel", "advertised"],
    "advertised_kept": ["advertised_joined"],
    "area_count": ["parcel"],
    "area_year": ["area_count", "sale_index"],
}

SHARE = "round_even(cast({part} as double) / nullif({whole}, 0) * 100, 2)"
EXACT_SUM = "cast(sum(cast({column} as decimal(18,2))) as double)"
KNOWN_AREAS = {"district": "council_district", "csa": "csa", "neighborhood": "neighborhood"}


def _share(part: str, whole: str) -> str:
    return SHARE.format(part=part, whole=whole)


def _sum(column: str) -> str:
    return EXACT_SUM.format(column=column)


def _half_even(total: str, rows: str) -> str:
    """total / rows as a whole number, ties to even, where both are whole numbers."""
    low, twice_rest = f"(({total}) // ({rows}))", f"(2 * (({total}) % ({rows})))"
    up = f"case when {twice_rest} > {rows} or ({twice_rest} = {rows} and {low} % 2 = 1) then 1 else 0 end"
    return f"({low} + {up})"


def _mean_2(column: str, units: int) -> str:
    """Mean with two digits; units per 1, e.g. 100 cents."""
    total = f"sum(cast(round({column} * {units}) as hugeint)) * {100 // units}"
    return f"({_half_even(total, f'nullif(count({column}), 0)')} / 100)"


def _strict(column: str, aggregate: str) -> str:
    return f"case when count({column}) = count(*) then {aggregate} end"


def _count(condition: str) -> str:
    return f"cast(count(case when {condition} then 1 end) as bigint)"


def _query(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """body preceded by the views it uses and the views those use."""
    ordered: dict[str, str] = {}

    def add(view: str) -> None:
        for needed in NEEDS.get(view, []):
            add(needed)
        ordered[view] = VIEWS[view]

    for view in views:
        add(view)
    ordered |= extra or {}
    if not ordered:
        return body
    stated = ",\n".join(f"{name} as ({sql})" for name, sql in ordered.items())
    return f"with {stated}\n{body}"


def _facts_by_area(source: str, areas: list[str], fallback: str | None = None) -> str:
    label = "{a}" if fallback is None else "coalesce({a}, '" + fallback + "')"
    return " union all ".join(
        f"select '{a}' as type, {label.format(a=a)} as area, * from {source}" for a in areas
    )


def _type_list(areas: list[str]) -> str:
    return ", ".join(f"'{a}'" for a in areas)


def _advertised_by_area(areas: list[str], fallback: str | None = None) -> str:
    homeowner = "coalesce(occupied in ('D', 'H'), false)"
    extra = {
        "fact": _facts_by_area("advertised_kept", areas, fallback),
        "cell": f"""
            select type, area, cast(count(*) as bigint) as num_advertised,
                coalesce({_sum('lien_amount')}, 0) as sum_lien_amount,
                {_strict('lien_amount', 'median(lien_amount)')} as median_lien_amount,
                {_strict('assessment', 'median(assessment)')} as median_assessed_value,
                {_strict('vacind', _count("vacind = 'Y'"))} as num_vacant,
                {_strict('no_imprv', _count("no_imprv = 'Y'"))} as num_vacant_lot,
                {_count(homeowner)} as num_owner_occupied,
                {_strict(f"({homeowner} and vacind <> 'Y')", _count(f"{homeowner} and vacind <> 'Y'"))}
                    as num_owner_occupied_not_vacant
            from fact group by type, area""",
    }
    body = f"""
        select a.area, a.type, a.num_properties,
            {_share('coalesce(num_advertised, 0)', 'a.num_properties')} as perc_properties_area,
            coalesce(num_advertised, 0) as num_advertised, sum_lien_amount,
            round(median_lien_amount, 3) as median_lien_amount,
            round(median_assessed_value, 3) as median_assessed_value,
            num_vacant, num_vacant_lot, num_owner_occupied, num_owner_occupied_not_vacant,
            {_share('num_vacant', 'num_advertised')} as perc_vacant,
            {_share('num_owner_occupied_not_vacant', 'num_advertised')} as perc_owner_occupied_not_vacant,
            {_share('num_vacant_lot', 'num_advertised')} as perc_vacant_lot,
            2002 as auction_year
        from area_count a left join cell c on a.type = c.type and a.area = c.area
        where a.type in ({_type_list(areas)})"""
    return _query(body, "advertised_kept", "area_count", extra=extra)


def _results_by_area_year(areas: list[str], repaired: bool = False) -> str:
    fallback = "Unknown" if repaired else None
    bids = (
        f""", coalesce({_sum('winning_bid')}, 0) as sum_winning_bids,
                {_mean_2('winning_bid', 100)} as mean_winning_bid,
                median(winning_bid) as median_winning_bid"""
        if repaired
        else ""
    )
    extra = {
        "fact": _facts_by_area("combined", areas, fallback),
        "base": f"""
            select type, area, auction_year, cast(count(*) as bigint) as num_advertised,
                {_count("removed = 'Y'")} as num_removed, {_count("removed = 'N'")} as num_scheduled,
                cast(count(winning_bidder_name) as bigint) as num_sold,
                {_strict('lien_amount', _sum('lien_amount'))} as sum_lien_amount,
                {_strict('lien_amount', 'median(lien_amount)')} as median_lien_amount,
                {_strict('assessed_value', 'median(assessed_value)')} as median_assessed_value,
                cast(count(distinct coalesce(winning_bidder_name, '<none>')) as bigint) as num_winning_bidders,
                {_mean_2('num_bids', 1)} as mean_num_bids{bids}
            from fact group by type, area, auction_year""",
        "homestead_cell": f"""
            select type, area, auction_year, cast(count(*) as bigint) as num_advertised_homestead,
                {_count("removed = 'N'")} as num_scheduled_homestead
            from fact where auction_year <> 2001 and homestead = 'Y' group by type, area, auction_year""",
        "occupancy_cell": f"""
            select type, area, auction_year, {_count("owner_occupied = '1'")} as num_owner_occupied,
                {_count("owner_occupied = '1' and removed = 'Y'")} as num_owner_occupied_removed,
                {_count("vacind = 'Y'")} as num_vacant
            from fact where auction_year = 2001 group by type, area, auction_year""",
    }
    repaired_columns = (
        ", sum_winning_bids, mean_winning_bid, round(median_winning_bid, 3) as median_winning_bid"
        if repaired
        else ""
    )
    body = f"""
        select g.area, g.type, a.num_properties,
            {_share('coalesce(b.num_advertised, 0)', 'a.num_properties')} as perc_properties_area,
            {_share('b.num_sold', 'a.num_properties')} as perc_properties_sold_area,
            g.auction_year, coalesce(b.num_advertised, 0) as num_advertised,
            num_removed, num_scheduled, num_sold, sum_lien_amount,
            round(median_lien_amount, 3) as median_lien_amount,
            round(median_assessed_value, 3) as median_assessed_value,
            num_winning_bidders, mean_num_bids,
            {_share('num_removed', 'b.num_advertised')} as perc_removed,
            num_advertised_homestead, num_scheduled_homestead,
            {_share('num_scheduled_homestead', 'num_advertised_homestead')} as perc_scheduled_homestead,
            num_owner_occupied, num_owner_occupied_removed, num_vacant,
            {_share('num_owner_occupied', 'b.num_advertised')} as perc_owner_occupied,
            {_share('num_owner_occupied_removed', 'num_owner_occupied')} as perc_owner_occupied_removed,
            {_share('num_vacant', 'b.num_advertised')} as perc_vacant{repaired_columns}
        from area_year g
            join area_count a on g.area = a.area and g.type = a.type
            left join base b on g.area = b.area and g.type = b.type and g.auction_year = b.auction_year
            left join homestead_cell h on g.area = h.area and g.type = h.type and g.auction_year = h.auction_year
            left join occupancy_cell o on g.area = o.area and g.type = o.type and g.auction_year = o.auction_year
        where g.type in ({_type_list(areas)})"""
    return _query(body, "combined", "area_year", extra=extra)


SHOWN = "adv_number, auction_year, auction_type, removed, lien_amount, objectid, owner_1, neighborhood, csa, council_district"
TITLE = """array_to_string(list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9]+'),
            lambda word: upper(word[1]) || lower(word[2:])), '')"""
ACCOUNT = """
        select *, case when k % 500 <> 42 then
            (case when k % 11 = 0 then lpad(cast(k // 10 as varchar), 4, '0') || 'B'
                  else '0' || lpad(cast(k // 10 as varchar), 4, '0') end) ||
            (case when k % 17 = 0 then lpad(cast(k % 10 as varchar), 2, '0') || 'A'
                  else lpad(cast(k % 10 as varchar), 3, '0') end) end as account_number
        from {source}"""
PARTS = """
        select *, case when regexp_matches(account_number[1:5], '[A-Za-z]') then account_number[1:5]
                else account_number[2:5] end as block,
            case when regexp_matches(account_number[6:], '[A-Za-z]') then account_number[6:]
                else account_number[7:] end as lot
        from account"""


def _typed_history(columns: str, *views: str, joined: str = "") -> str:
    extra = {
        "account": ACCOUNT.format(source="(select *, o_custkey as k from orders)"),
        "parts": PARTS,
        "typed": f"""
            select cast(o_orderkey as integer) as adv_number, account_number, block, lot, block || lot as pin,
                case when o_orderstatus = 'F' then {TITLE.format(text='o_orderpriority')} end as removed_because,
                case when o_orderstatus = 'F' then 'Y' else 'N' end as removed,
                case when o_orderstatus = 'F' then cast(o_orderdate as date) end as removed_date,
                case o_orderkey % 3 when 0 then 'Y' when 1 then 'N' end as homestead,
                cast(year(o_orderdate) - 1 as integer) as tax_year,
                cast(nullif(o_orderkey % 6, 0) as integer) as num_ties,
                cast(o_orderkey % 13 as integer) as num_bids,
                case when o_orderstatus = 'O' then round(o_totalprice * 3, 2) end as winning_bid,
                case when o_orderstatus = 'O' then o_totalprice end as winning_bid_premium,
                case when o_orderstatus = 'O' then cast(o_custkey % 97 as varchar) end as winning_bidder_number,
                case when o_orderkey % 5 <> 0 then o_totalprice end as winning_bidder_amt_due,
                case when o_orderkey % 5000 <> 7 then o_totalprice end as lien_amount,
                round(o_totalprice * 10, 2) as assessed_value,
                case when o_orderstatus = 'O' then 'B' || cast(o_custkey % 97 as varchar) end as winning_bidder_name,
                cast(year(o_orderdate) as integer) as auction_year,
                case when o_orderkey % 2 = 0 then 'certificate_sale' else 'assignment_sale' end as auction_type
            from parts""",
    }
    return _query(f"select {columns} from typed {joined}", *views, extra=extra)


def _advertised_typed() -> str:
    shared = """cast(l_partkey as varchar) || ' MAIN ST' as street_name,
            cast(l_partkey // 10 as varchar) as block, cast(l_partkey % 10 as varchar) as lot,
            cast(l_partkey % 24 as varchar) as ward, cast(nullif(l_partkey % 3, 0) as varchar) as section,
            round(l_extendedprice * 10, 2) as assessment,
            case when l_linenumber <> 6 then l_extendedprice end as lien_amount,
            case when l_linenumber = 7 then null when l_returnflag = 'A' then 'D' else 'N' end as occupied,
            2001 as tax_year, 2002 as auction_year"""
    return f"""
        select cast(l_orderkey as integer) as adv_number, {shared} from lineitem
        union all
        select cast(null as integer) as adv_number, {shared} from lineitem"""


def _quality_block(area: str, label: str, values: str) -> str:
    matched, unmatched = "count(objectid)", _count("objectid is null")
    vacant, lot = _count("vacind = 'Y'"), _count("no_imprv = 'Y'")
    owner = _count("occupied in ('H', 'D')")
    return f"""
        select {area} as area_name, cast(count(*) as bigint) as num_properties,
            cast({matched} as bigint) as num_matched, {unmatched} as num_unmatched,
            {_share(unmatched, 'count(*)')} as perc_unmatched, {_share(matched, 'count(*)')} as perc_matched,
            {values},
            {vacant} as num_vacant, {_share(vacant, matched)} as perc_vacant,
            {lot} as num_vacant_lot, {_share(lot, matched)} as perc_vacant_lot,
            {owner} as num_owner_occupied, {_share(owner, 'count(*)')} as perc_owner_occupied,
            '{label}' as type
        from advertised_kept group by {area}"""


def _match_quality(measures: dict[str, str], body: str = "select * from quality") -> str:
    """measures: output prefix to an aggregate with {c} for the column and {n} for the row count."""
    values = ", ".join(
        f"{_strict(c, sql.format(c=c))} as {kind}_{c}"
        for c in ("assessment", "lien_amount")
        for kind, sql in measures.items()
    )
    labels = {"council_district": "council district", "csa": "csa", "neighborhood": "neighborhood"}
    quality = " union all ".join(_quality_block(area, label, values) for area, label in labels.items())
    return _query(body, "advertised_kept", extra={"quality": quality})


def _quality_numbers() -> str:
    total = EXACT_SUM.format(column="{c}")
    return _match_quality(
        {"mean": total + " / count({c})", "median": "round(median({c}), 3)", "sum": total}
    )


def _quality_texts() -> str:
    """Money in whole cents, printed as text."""
    cents = "sum(cast(round({c} * 100) as hugeint))"
    measures = {
        "mean": _half_even(cents, "count({c})"),
        "median": _half_even("cast(round(median({c}) * 1000) as hugeint)", "10"),
        "sum": cents,
    }
    shown = ["area_name", "num_properties"]
    shown += [
        f"'$' || format('{{:,.2f}}', cast({kind}_{c} as double) / 100) as {kind}_{c}"
        for c in ("assessment", "lien_amount")
        for kind in measures
    ]
    for share in ("vacant", "vacant_lot", "owner_occupied"):
        shown += [f"num_{share}", f"format('{{:.2f}}', perc_{share}) || '%' as perc_{share}"]
    return _match_quality(measures, f"select {', '.join(shown)}, type from quality")


def _audit() -> str:
    def one(name: str, fact: str, parcel: str, on: str, kept: str) -> str:
        return f"""
            select '{name}' as match,
                (select count(*) from ({fact})) as rows_in,
                (select count(*) from ({fact}) f where exists (select 1 from {parcel} p where {on})) as rows_matched,
                (select count(*) from ({fact}) f where not exists (select 1 from {parcel} p where {on})) as rows_unmatched,
                (select count(*) from ({fact}) f left join {parcel} p on {on}) as rows_after_join,
                (select count(*) from (select distinct {kept} from ({fact}))) as rows_kept,
                (select count(*) from (select distinct {kept} from ({fact}) f
                    where exists (select 1 from {parcel} p where {on}))) as rows_kept_matched"""

    def same(*keys: str) -> str:
        return " and ".join(f"f.{k} is not distinct from p.{k}" for k in keys)

    latest_keys = same("block", "lot", "ward")
    parts = [
        one("history", "select * from result where auction_year < 2001", "parcel_dup", same("pin"), "pin, auction_year"),
        one("latest", "select * from result where auction_year = 2001", "parcel_dup", latest_keys, "adv_number"),
        one("advertised", "select * from advertised", "parcel", same("block", "lot", "ward", "section"), "block, lot, ward, section"),
    ]
    return _query(" union all ".join(parts), "parcel_dup", "result", "advertised")


BINS = """
    select a.*, lien_amount / 1000 as v, round(c.x, 6) as x, round(c.y, 6) as y
    from advertised_kept a left join centre c on a.objectid = c.k
    where occupied in ('D', 'H') and vacind = 'N' and no_imprv = 'N'"""
# Breaks by row position in whole numbers; equal breaks are merged.
BREAKS = """
    select list(distinct b order by b) as breaks from (
        select i, sum(v * case when place = low then 1 - up else 0 end
                    + v * case when place = low + 1 then up else 0 end) as b
        from (
            select i, v, place, (total - 1) * i // 5 as low, ((total - 1) * i % 5) / 5.0::double as up
            from (select v, row_number() over (order by v) - 1 as place, count(*) over () as total
                  from home where v is not null), range(0, 6) as steps(i))
        group by i)"""
BINNED = """
    select home.*, case when v is not null then greatest(1, len(list_filter(breaks, lambda b: b < v))) end as bin,
        breaks
    from home, breaks"""


def _bins(counts: bool) -> str:
    extra = {"home": BINS, "breaks": BREAKS, "binned": BINNED}
    limits = """cast(bin as integer) as lien_bin, round(breaks[bin], 6) as lien_bin_low,
            case when bin is not null then round(breaks[least(bin + 1, len(breaks))], 6) end as lien_bin_high"""
    body = f"select block, lot, ward, section, lien_amount, {limits}, x, y from binned"
    if counts:
        body = f"select {limits}, cast(count(*) as bigint) as num_properties from binned group by all"
    return _query(body, "advertised_kept", "centre", extra=extra)


def _choropleth() -> str:
    extra = {
        "summary": _advertised_by_area(["council_district"]),
        "box": """
            select c_mktsegment as name, min(c_custkey % 1000 * 10) as x0, max(c_custkey % 1000 * 10 + 8) as x1,
                min(c_custkey // 1000 * 10) as y0, max(c_custkey // 1000 * 10 + 6) as y1
            from customer group by c_mktsegment""",
        "boundary": """
            select case when name = 'BUILDING' then 'BUILDING (OLD)' else name end as name,
                (x0 + x1) / 2 as x, (y0 + y1) / 2 as y from box""",
    }
    body = """
        select name, num_advertised, num_owner_occupied_not_vacant, perc_properties_area,
            cast(x as double) as x, cast(y as double) as y
        from boundary left join summary on name is not distinct from area"""
    return _query(body, extra=extra)


def _district_report() -> str:
    removed, late = "removed = 'Y'", "removed = 'Y' and removed_date > date '2001-04-30'"
    owner, owner_removed = "owner_occupied = '1'", "owner_occupied = '1' and removed = 'Y'"
    scheduled = "removed = 'N'"
    body = f"""
        select council_district as id, cast(count(*) as bigint) as num_properties,
            {_count(removed)} as removed_properties, {_count(scheduled)} as scheduled_properties,
            {_share(_count(removed), 'count(*)')} as perc_removed,
            {_count(late)} as properties_removed_after_original_deadline,
            {_count(owner)} as num_owner_occupied, {_count(owner_removed)} as num_owner_occupied_removed,
            {_share(_count(owner), 'count(*)')} as perc_owner_occupied,
            {_share(_count(owner_removed), _count(owner))} as perc_owner_occupied_removed
        from latest group by council_district"""
    return _query(body, "latest")


def _bidder_summary() -> str:
    body = f"""
        select auction_year, winning_bidder_name, cast(count(*) as bigint) as num_bids_won,
            {_count("homestead = 'Y'")} as num_homestead,
            {_sum('winning_bid')} / nullif(count(winning_bid), 0) as mean_winning_bid,
            round(median(winning_bid), 3) as median_winning_bid,
            coalesce({_sum('winning_bid')}, 0) as sum_winning_bid_amount,
            {_share(_count("homestead = 'Y'"), 'count(*)')} as perc_homestead_properties
        from combined where auction_year <> 2001 and removed = 'N' and winning_bidder_name is not null
        group by auction_year, winning_bidder_name"""
    return _query(body, "combined")


def _deadline() -> str:
    facts = _facts_by_area("combined", list(KNOWN_AREAS.values()))
    late = "removed = 'Y' and removed_date > make_date(auction_year, 4, 30)"
    body = f"""
        select type, area, auction_year, cast(count(*) as bigint) as num_advertised,
            {_count(late)} as num_removed_after_deadline
        from ({facts}) group by type, area, auction_year"""
    return _query(body, "combined")


def _reproject() -> str:
    """The projection formula with every constant worked out in SQL."""
    extra = {
        "ellipsoid": "select 6378137.0::double as a, sqrt(2 / 298.257222101 - power(1 / 298.257222101, 2)) as e",
        "parallel": """
            select name, radians(deg) as phi,
                cos(radians(deg)) / sqrt(1 - power(e * sin(radians(deg)), 2)) as m,
                tan(pi() / 4 - radians(deg) / 2)
                    / power((1 - e * sin(radians(deg))) / (1 + e * sin(radians(deg))), e / 2) as t
            from ellipsoid, (values ('south', 38.3::double), ('north', 39.45::double),
                                    ('origin', 37.666666666666664::double)) p(name, deg)""",
        "cone": """
            select s.m as m, s.t as t, o.t as t0, (ln(s.m) - ln(n.m)) / (ln(s.t) - ln(n.t)) as n
            from parallel s, parallel n, parallel o
            where s.name = 'south' and n.name = 'north' and o.name = 'origin'""",
        "place": """
            select c_custkey as objectid, radians(-76.75::double + c_custkey % 1000 * 0.0003::double) as lon,
                radians(39.2::double + c_custkey % 777 * 0.0002::double) as lat
            from customer""",
        "polar": """
            select objectid, n * (lon - radians(-77::double)) as theta,
                a * m / (n * power(t, n)) * power(t0, n) as r0,
                a * m / (n * power(t, n)) * power(
                    tan(pi() / 4 - lat / 2) / power((1 - e * sin(lat)) / (1 + e * sin(lat)), e / 2), n) as r
            from place, ellipsoid, cone""",
    }
    body = """
        select objectid, round(400000 + r * sin(theta), 3) as x, round(r0 - r * cos(theta), 3) as y from polar"""
    return _query(body, extra=extra)


def _plain(number: str) -> str:
    return f"regexp_replace(cast({number} as varchar), '[.]0$', '')"


def _published() -> str:
    numbers = ["cast(num_sold as varchar)", _plain("total"), f"coalesce({_plain('half')}, 'NA')", _plain("perc"), "rows_ || '000'"]
    return f"""
        with summary as (
            select n_name as area, {_count("o_orderstatus = 'O'")} as num_sold, {_sum('o_totalprice')} as total,
                case when n_name <> 'NATION_4' then min(o_totalprice) / 2 end as half,
                {_share(_count("o_orderstatus = 'O'"), 'count(*)')} as perc, count(*) as rows_
            from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
            group by n_name)
        select cast(1 as integer) as number, 'area,num_sold,sum_lien_amount,half_smallest,perc_sold,thousands' as line
        union all
        select cast(1 + row_number() over (order by area) as integer), concat_ws(',', area, {', '.join(numbers)}) from summary"""


def _file_queries() -> dict[str, str]:
    return {
        "files_history_typed": _typed_history("*"),
        "files_with_index": _typed_history(
            "adv_number, tax_year, auction_year, auction_type, auction_label, auction_date",
            "sale_index",
            joined="left join sale_index using (tax_year, auction_year, auction_type)",
        ),
        "files_first_rows": _typed_history(
            "pin, auction_year, auction_type, adv_number",
            joined="qualify row_number() over (partition by pin, auction_year order by auction_type, adv_number desc) = 1",
        ),
        "files_ragged_rows": """
            select 'orders_' || o_orderstatus || '.csv' as file, count(*) filter (fits) as rows_typed,
                cast(count(*) filter (not fits) as bigint) as rows_rejected,
                cast(sum(o_orderkey) filter (fits) as bigint) as sum_number,
                cast(coalesce(sum(length(line)) filter (not fits), 0) as bigint) as rejected_length
            from (select *, (o_orderkey % 97 = 6) = (o_orderkey % 89 = 5) as fits,
                concat_ws(',', o_orderkey, o_custkey, case when o_orderkey % 97 <> 6 then o_orderstatus end,
                    case when o_orderkey % 89 = 5 then 'more' end) as line from orders)
            group by o_orderstatus""",
        "files_published": _published(),
        "table_years": _query(
            f"""select auction_year, count(*) as num_rows, count(distinct adv_number) as num_numbers,
                {_sum('lien_amount')} as sum_lien_amount from result group by auction_year""",
            "result",
        ),
        "table_parcels": _query(
            """select objectid, pin, ward, neighborhood, round(x, 6) as x, round(y, 6) as y
                from parcel left join centre on objectid = k""",
            "parcel",
            "centre",
        ),
        "table_parcels_binary": _query(
            """select objectid, case when k is null then 'missing' when broken then 'broken' else 'read' end as geometry_status,
                case when not broken then round(x, 6) end as x, case when not broken then round(y, 6) end as y
                from (select *, objectid % 250 = 3 as broken from parcel) left join centre on objectid = k""",
            "parcel",
            "centre",
        ),
        "table_text": _advertised_typed().split("union all")[0],
        "bidder_sketches": _query(
            f"""select type, area, cast(count(distinct winning_bidder_name)
                    + max(case when winning_bidder_name is null then 1 else 0 end) as bigint) as num_distinct_winning_bidder_name
                from ({_facts_by_area('combined', list(KNOWN_AREAS.values()))}) group by type, area""",
            "combined",
        ),
        "exact_sums": """
            select l_returnflag, cast(sum(case when l_orderkey % 50 = 3
                    then (case when l_linenumber % 2 = 0 then -8 else 8 end)::hugeint
                        * (100000000000000000::hugeint + l_orderkey % 1000 * 16)
                    else (l_orderkey * 7 + l_partkey)::hugeint end) as double) / 8 as exact,
                count(*) as num_values
            from lineitem group by l_returnflag""",
        "reproject_back": """
            select c_custkey as objectid, round(-76.75 + c_custkey % 1000 * 0.0003::double, 9) as x0,
                round(39.2::double + c_custkey % 777 * 0.0002::double, 9) as y0,
                round(-76.75 + c_custkey % 1000 * 0.0003::double + 0.5, 9) as x1,
                round(39.2::double + c_custkey % 777 * 0.0002::double - 0.25, 9) as y1
            from customer""",
    }


def oracle_sql() -> dict[str, str]:
    every = list(KNOWN_AREAS.values())
    sql = {
        "area_property_count": _query("select * from area_count", "area_count"),
        "area_year_grid": _query("select * from area_year", "area_year"),
        "area_list_year_grid": _query("select area, type, 2002 as auction_year from area_count", "area_count"),
        "advertised_by_area_all": _advertised_by_area(every),
        "advertised_by_area_all_repaired": _advertised_by_area(every, "Unknown"),
        "results_by_area_year_all": _results_by_area_year(every),
        "results_by_area_year_all_repaired": _results_by_area_year(every, repaired=True),
        "results_typed": _typed_history("*"),
        "latest_typed": f"""
            select cast(o_orderkey % 10 as varchar) as batch_number, cast(o_orderkey as integer) as adv_number,
                case when o_orderstatus = 'O' then cast(o_orderkey + 500 as varchar) end as certificate_number,
                cast(o_custkey // 10 as varchar) as block, cast(o_custkey % 10 as varchar) as lot,
                cast(o_custkey % 24 as varchar) as ward,
                case when o_orderkey % 50 <> 7 then o_totalprice end as lien_amount,
                round(o_totalprice * 10, 2) as assessed_value,
                case when o_orderstatus = 'O' then round(o_totalprice * 3, 2) end as winning_bid,
                0.0::double as winning_bid_premium,
                case when o_orderstatus = 'O' then o_totalprice end as winning_bidder_amt_due,
                case when o_orderstatus = 'O' then 'B' || cast(o_custkey % 97 as varchar) end as winning_bidder_name,
                2000 as tax_year,
                case when o_orderstatus = 'F' then {TITLE.format(text='o_orderpriority')} end as removed_because,
                case when o_orderstatus = 'F' then cast(o_orderdate as date) end as removed_date,
                case when o_orderkey % 4 = 0 then '1' when o_orderkey % 4 < 3 then '0' end as owner_occupied,
                case when o_orderstatus = 'F' then 'Y' else 'N' end as removed,
                'certificate_sale' as auction_type, 2001 as auction_year
            from orders where year(o_orderdate) = 2001""",
        "advertised_typed": _advertised_typed(),
        "account_to_pin": _query(
            "select c_custkey, account_number, block, lot, block || lot as pin from parts",
            extra={"account": ACCOUNT.format(source="(select c_custkey, c_custkey as k from customer)"), "parts": PARTS},
        ),
        "results_with_index": _typed_history(
            "adv_number, tax_year, auction_year, auction_type, auction_label, auction_date",
            "sale_index",
            joined="left join sale_index using (tax_year, auction_year, auction_type)",
        ),
        "results_matched_first": _query(
            f"""select pin, block, lot, {SHOWN}, round(x, 6) as x, round(y, 6) as y
                from history left join centre on objectid % {COPY_OFFSET} = k""",
            "history",
            "centre",
        ),
        "results_latest_matched_first": _query(
            f"""select block, lot, ward, {SHOWN}, round(x, 6) as x, round(y, 6) as y
                from latest left join centre on objectid % {COPY_OFFSET} = k""",
            "latest",
            "centre",
        ),
        "advertised_matched_first": _query(
            """select block, lot, ward, section, adv_number, line_number, lien_amount, assessment, occupied,
                vacind, no_imprv, objectid, owner_1, neighborhood, csa, council_district from advertised_kept""",
            "advertised_kept",
        ),
        "results_union": _query(
            f"""select {SHOWN}, tax_year, removed_because, removed_date, winning_bidder_name, assessed_value,
                winning_bid, num_bids, homestead, owner_occupied, vacind from combined""",
            "combined",
        ),
        "bidder_summary": _bidder_summary(),
        "match_quality": _quality_numbers(),
        "area_report": _quality_texts(),
        "match_audit": _audit(),
        "removed_after_deadline": _deadline(),
        "choropleth_input": _choropleth(),
        "lien_bins": _bins(counts=False),
        "lien_bin_counts": _bins(counts=True),
        "district_report": _district_report(),
        "unknown_area_loss": _query(
            f"""select type, cast(count(*) as bigint) as rows_in, cast(count(area) as bigint) as rows_shown,
                {_count('area is null')} as rows_lost
                from ({_facts_by_area('advertised_kept', every)}) group by type""",
            "advertised_kept",
        ),
        "parcel_centroid": _query(
            """select c_custkey as objectid, round(x, 6) as x, round(y, 6) as y
                from customer left join centre on c_custkey = k""",
            "centre",
        ),
        "reproject_lcc": _reproject(),
    }
    sql |= _file_queries()
    sql["results_by_area_year_sketched"] = sql["results_by_area_year_all_repaired"]
    for label, area in KNOWN_AREAS.items():
        sql[f"advertised_by_area_{label}"] = _advertised_by_area([area])
        sql[f"results_by_area_year_{label}"] = _results_by_area_year([area])
    return sql
