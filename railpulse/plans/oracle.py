"""DuckDB statements that compute each query independently.

They start from the shared test tables themselves and share no code with the
operators but the fixed values.
"""

from __future__ import annotations

from railpulse import dimensions as D
from railpulse.operators.experiment import SALT

K = "cast(json_extract_string(props, '$.k') as integer)"


def _case_of(index: str, labels: list[str]) -> str:
    arms = " ".join(f"when {i} then '{label}'" for i, label in enumerate(labels))
    return f"case {index} {arms} end"


_UNKNOWN_FIRST = ["ERR_UNMAPPED"] + [c for c, *_ in D.ERROR_CODES if c != "ERR_SUCCESS"]

SOURCES = {
    "ec": f"select * from (values {D.values_sql(D.ERROR_CODES)}) v(code, category, description, decline)",
    "bank": f"select * from (values {D.values_sql(D.BANKS)}) v(id, name, kind)",
    "stage": f"select * from (values {D.values_sql(D.STAGES)}) v(stage_id, stage_name)",
    "tx": f"""
        select event_id as id, user_id, ts, cast(value * 40 as decimal(18,2)) as amount,
               'BNK' || lpad(cast(1 + {K} % 10 as varchar), 3, '0') as payer,
               'BNK' || lpad(cast(1 + ({K} // 10) % 4 as varchar), 3, '0') as payee,
               case when {K} % 20 < 9 then 'P2P' else 'P2M' end as kind,
               event_id % 200 as device,
               {_case_of("event_id % 4", ["4G", "5G", "WiFi", "3G"])} as network,
               event_type <> 'error' as ok, event_type = 'error' as bad,
               case when event_type = 'error' then {_case_of("event_id % 11", _UNKNOWN_FIRST)}
                    else 'ERR_SUCCESS' end as code
        from events""",
    "again": """
        select id * 2 as id, user_id, payee, amount, ts, ok, bad from tx
        union all
        select id * 2 + 1, user_id, payee, amount, ts + to_seconds(1 + id % 400), ok, bad from tx where id % 7 = 0""",
    "again_coded": """
        select id * 2 as id, user_id, ts, ok, bad, code from tx
        union all
        select id * 2 + 1, user_id, ts + to_seconds(1 + id % 400), ok, bad, code from tx where id % 7 = 0""",
    "coded": """
        select tx.*, ec.category, ec.description, ec.decline, ec.code as known
        from tx left join ec on ec.code = tx.code""",
    "usr": """
        select c_custkey as user_id, c_mktsegment as segment, n_name as state,
               1335 - (c_custkey * 37) % 1200 as tenure,
               case c_custkey % 5 when 0 then '18-24' when 1 then '25-34' when 2 then '35-44'
                                  when 3 then '45-59' else '60+' end as age
        from customer join nation on n_nationkey = c_nationkey""",
    "raw": f"""
        select l_orderkey * 10 + l_linenumber as transaction_id,
               case when l_quantity = 50 then '' when l_quantity < 49
                    then 'USR' || cast(l_orderkey % 150 as varchar) end as user_id,
               case l_suppkey % 10 when 0 then 'SBI' when 1 then 'hdfc bank' when 2 then ' ICICI_BANK '
                    when 3 then 'AXIS'
                    else 'BNK' || lpad(cast(l_suppkey % 10 + 1 as varchar), 3, '0') end as payer_bank_id,
               case when l_partkey % 97 <> 0
                    then 'BNK' || lpad(cast(1 + l_partkey % 10 as varchar), 3, '0') end as payee_bank_id,
               case when l_discount = 0 and l_tax = 0
                    then cast(-l_extendedprice as varchar)
                    when l_discount = 0 and l_tax = 0.01 then 'n/a'
                    else cast(l_extendedprice as varchar) end as amount_text,
               l_shipdate as "timestamp",
               case when l_partkey % 20 < 9 then 'P2P' else 'P2M' end as transaction_type,
               'DEV' || cast(l_partkey % 200 as varchar) as device_id,
               case when l_returnflag = 'A' then '4G' when l_returnflag = 'R' then '5G'
                    when l_linestatus = 'O' then '' end as network_type,
               {_case_of("l_partkey % 5", ["APP1", "APP2", "APP3", "APP4", "APP5"])} as payment_app,
               case when l_quantity = 13 then '' when l_tax >= 0.07 then 'FAILED' else 'SUCCESS' end as final_status,
               case when l_tax >= 0.07 then {_case_of("l_partkey % 11", _UNKNOWN_FIRST)}
                    else 'ERR_SUCCESS' end as failure_code,
               l_partkey * 100000000 + l_suppkey * 100 + cast(l_quantity as bigint) as seq
        from lineitem""",
    "parsed": "select *, try_cast(amount_text as decimal(18,2)) as amount from raw",
    "step": """
        select l_orderkey as id, l_linenumber as stage_id, l_shipdate as ts, l_returnflag = 'R' as bad
        from lineitem""",
    "chain": """
        select tx.*, lead(id) over w as next_id, lead(ok) over w as next_ok, lead(amount) over w as next_amount,
               date_diff('microsecond', ts, lead(ts) over w) as gap
        from tx window w as (partition by user_id order by ts, id)""",
    "reach": """
        select id, stage_id, min(ts) as ts from step where stage_id between 1 and 7 group by all""",
}
NEEDS = {"again": ["tx"], "again_coded": ["tx"], "coded": ["tx", "ec"], "parsed": ["raw"], "chain": ["tx"], "reach": ["step"]}


def _with(names: str, body: str) -> str:
    """The body with the named source relations (and theirs) in front."""
    wanted: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    return "with " + ",\n".join(f"{n} as ({SOURCES[n]})" for n in wanted) + "\n" + body


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(100.0 * cast({part} as double) / nullif(cast({whole} as double), 0), {digits})"


def n_if(condition: str) -> str:
    return f"count(*) filter (where {condition})"


def value(expr: str) -> str:
    return f"round(cast({expr} as double), 2)"


OK, BAD = n_if("ok"), n_if("bad")
TD_WIDE, BD_WIDE = n_if("decline = 'Technical Decline'"), n_if("decline = 'Business Decline'")
NET = n_if("category = 'Timeout/Network'")
TD, BD = n_if("code like 'ERR_TD%'"), n_if("code like 'ERR_BD%'")
AT_RISK = "coalesce(sum(amount) filter (where bad), 0)"
HOUR = "cast(extract(hour from ts) as integer)"
MEAN = "round(avg(amount), 2)"

CLEAN_COLUMNS = """transaction_id, user_id, payer_bank_id, payee_bank_id, cast(amount as double) as amount,
    "timestamp", transaction_type, device_id, network_type, payment_app, final_status, failure_code"""


def _canonical(bank: str, key: str) -> str:
    return f"""case when {key} in ('SBI', 'STATE BANK OF INDIA') then 'BNK001'
        when {key} in ('HDFC', 'HDFC BANK') then 'BNK002'
        when {key} in ('ICICI', 'ICICI_BANK') then 'BNK003' else {bank} end"""


def _bucket(contiguous: bool) -> str:
    if contiguous:
        return """case when amount < 100 then '1. Micro (< Rs 100)' when amount <= 500 then '2. Small (Rs 100 - 500)'
            when amount <= 2000 then '3. Medium (Rs 501 - 2000)' when amount <= 10000 then '4. High (Rs 2001 - 10000)'
            else '5. Very High (> Rs 10000)' end"""
    return """case when amount < 100 then '1. Micro (< Rs 100)'
        when amount >= 100 and amount <= 500 then '2. Small (Rs 100 - 500)'
        when amount >= 501 and amount <= 2000 then '3. Medium (Rs 501 - 2000)'
        when amount >= 2001 and amount <= 10000 then '4. High (Rs 2001 - 10000)'
        else '5. Very High (> Rs 10000)' end"""


def _audit() -> dict[str, str]:
    missing = {
        "missing_users": "user_id",
        "missing_payer_banks": "payer_bank_id",
        "missing_payee_banks": "payee_bank_id",
        "missing_networks": "network_type",
        "missing_statuses": "final_status",
    }
    blanks = ", ".join(f"{n_if(f'''coalesce({c}, '') = '' ''')} as {name}" for name, c in missing.items())
    strip = r"regexp_replace(payer_bank_id, '^\s+|\s+$', '', 'g')"
    return {
        "dq_duplicates": _with(
            "raw",
            """select 'Duplicate Transactions' as anomaly_type, count(*) as affected_records,
                      'De-duplicate by taking FIRST_VALUE by timestamp' as recommended_action
               from (select 1 from raw group by transaction_id having count(*) >= 2)""",
        ),
        "dq_bank_aliases": _with(
            "raw",
            """select payer_bank_id, count(*) as transaction_count,
                      case payer_bank_id when 'SBI' then 'Map to BNK001 (State Bank of India)'
                           when 'State Bank Of India' then 'Map to BNK001 (State Bank of India)'
                           when 'HDFC BANK' then 'Map to BNK002 (HDFC Bank)'
                           when 'hdfc bank' then 'Map to BNK002 (HDFC Bank)'
                           when 'ICICI_BANK' then 'Map to BNK003 (ICICI Bank)'
                           else 'Unknown Bank Alias' end as data_quality_status
               from raw where payer_bank_id not like 'BNK%' group by 1""",
        ),
        "dq_invalid_amounts": _with(
            "raw",
            """select count(*) as invalid_amount_records, min(number) as min_amount_found,
                      max(number) as max_amount_found, 'Filter out amount <= 0' as cleaning_rule
               from (select try_cast(amount_text as double) as number from raw) where number <= 0 and isfinite(number)""",
        ),
        "dq_missing": _with("raw", f"select {blanks} from raw"),
        "dq_audit_summary": _with(
            "parsed",
            f"""select count(*) as raw_transaction_count,
                   {n_if("taken > 0")} as duplicate_transactions_removed,
                   {n_if("taken = 0 and good and upper(" + strip + ") in ('SBI', 'STATE BANK OF INDIA', 'HDFC', 'HDFC BANK', 'ICICI', 'ICICI_BANK')")}
                       as inconsistent_bank_names_standardized,
                   {n_if("taken = 0 and not good")} as invalid_amounts_dropped,
                   {n_if("taken = 0 and good and coalesce(network_type, '') = ''")} as missing_values_imputed,
                   {n_if("taken = 0 and good")} as processed_transaction_count
                from (select *, coalesce(amount > 0, false) as good,
                             count(*) filter (where amount > 0) over (partition by transaction_id order by seq
                                 rows between unbounded preceding and 1 preceding) as taken
                      from parsed)""",
        ),
        "clean_view": _with(
            "parsed",
            f"""select {CLEAN_COLUMNS} from (
                  select * replace ({_canonical("payer_bank_id", "upper(trim(payer_bank_id))")} as payer_bank_id,
                                    case when coalesce(network_type, '') = '' then '4G' else network_type end as network_type)
                  from parsed where amount > 0)
                qualify row_number() over (partition by transaction_id order by "timestamp",
                  user_id nulls first, payer_bank_id nulls first, payee_bank_id nulls first, amount,
                  transaction_type, device_id, network_type, payment_app, final_status, failure_code) = 1""",
        ),
        "clean_transactions": _with(
            "parsed",
            f"""select {CLEAN_COLUMNS} from (
                  select p.* replace ({_canonical(strip, "upper(" + strip + ")")} as payer_bank_id,
                                      case when coalesce(network_type, '') = '' then '4G' else network_type end as network_type)
                  from parsed p
                  join (select transaction_id as tid, min(seq) as first_seq from parsed where amount > 0 group by 1) f
                    on p.transaction_id = f.tid and p.seq = f.first_seq)""",
        ),
        "clean_stage_events": _with(
            "parsed",
            """select transaction_id, cast(stage_id as integer) as stage_id, "timestamp" as event_timestamp,
                      case when final_status = 'FAILED' then 'FAILED' else 'SUCCESS' end as stage_status,
                      cast(null as varchar) as error_code
               from raw, unnest(range(1, 2 + transaction_id % 7)) s(stage_id)
               where transaction_id in (select transaction_id from parsed where amount > 0)""",
        ),
        "publish_dims": _with(
            "bank ec usr",
            """select 'banks' as table_name, id as row_key, concat_ws('|', id, name, kind) as row_text from bank
               union all select 'error_codes', code, concat_ws('|', code, category, description, decline) from ec
               union all select 'devices', cast(p_partkey as varchar),
                      concat_ws('|', p_partkey, p_type, p_size, p_brand) from part
               union all select 'users', cast(user_id as varchar),
                      concat_ws('|', user_id, date '2023-01-01' + cast(user_id * 37 % 1200 as integer), segment, state, age, tenure)
               from usr""",
        ),
    }


def _indicators() -> dict[str, str]:
    kpi = f"""select count(*) as total_transactions, {OK} as successful_transactions, {BAD} as failed_transactions,
        {pct(OK, "count(*)")} as psr_percentage, {pct(BAD, "count(*)")} as failure_rate_percentage,
        {pct(TD_WIDE, "count(*)")} as technical_decline_rate, {pct(BD_WIDE, "count(*)")} as business_decline_rate,
        {pct(NET, "count(*)")} as timeout_decline_rate, {value("sum(amount)")} as total_value_inr,
        {value("sum(amount) filter (where ok)")} as successful_value_inr, {value(AT_RISK)} as value_at_risk_inr,
        {pct(AT_RISK, "sum(amount)")} as pct_value_at_risk, {MEAN} as avg_txn_amount_inr from coded"""
    recoverable = """(select cast(sum(amount) as double) as lost,
        cast(sum(amount) filter (where decline = 'Technical Decline' or category = 'Timeout/Network') as double) as tech,
        cast(sum(amount) filter (where known = 'ERR_BD_02') as double) as soft
        from coded where bad and known is not null)"""
    wide = ", ".join(
        f"round({t} * tech + {s} * soft, 2) as {name}_recovered_value_inr, "
        f"{pct(f'({t} * tech + {s} * soft)', 'lost')} as {name}_recovery_pct"
        for name, t, s in [("conservative", "0.15::double", "0.10::double"), ("base_case", "0.35::double", "0.25::double"), ("optimistic", "0.60::double", "0.45::double")]
    )
    return {
        "core_kpis": _with("coded", kpi),
        "status_breakdown": _with(
            "tx",
            """select case when ok then 'Success (90.42%)' when code like 'ERR_TD%' then 'Technical Decline (4.68%)'
                      when code like 'ERR_BD%' then 'Business Decline (3.82%)'
                      else 'Network Timeout (1.08%)' end as status_category, count(*) as "count"
               from tx group by 1""",
        ),
        "recovery_scenarios": _with(
            "coded",
            f"""select round(lost, 2) as total_transaction_value_at_risk_inr, round(tech, 2) as recoverable_technical_value_inr,
                   round(soft, 2) as soft_business_decline_value_inr, {wide} from {recoverable}""",
        ),
        "recovery_by_scenario": _with(
            "coded",
            f"""select scenario, round(t * tech + s * soft, 2) as recovered_value_inr,
                   {pct("(t * tech + s * soft)", "lost")} as recovery_pct
                from {recoverable}, (values ('conservative', 0.15::double, 0.10::double),
                    ('base_case', 0.35::double, 0.25::double), ('optimistic', 0.60::double, 0.45::double)) v(scenario, t, s)""",
        ),
        "limit_breaches": _with(
            "coded",
            f"""select metric, rate as observed, upper_limit, round(rate - upper_limit, 2) as excess
                from (select 'technical_decline_rate' as metric, {pct(TD_WIDE, "count(*)")} as rate, 1.0::double as upper_limit
                      from coded
                      union all
                      select 'duplicate_payment_rate', {pct(n_if("gap <= 180000000"), "count(*)")}, 0.01::double
                      from (select date_diff('microsecond', lag(ts) over (partition by user_id, payee, amount order by ts, id), ts) as gap
                            from tx where ok))
                where rate > upper_limit or rate is null""",
        ),
        "failure_breakdown": _with(
            "coded",
            f"""select *, cast(dense_rank() over (order by failure_count desc) as integer) as failure_rank from (
                  select coalesce(decline, 'Other') as decline_type, coalesce(category, 'Unknown') as error_category,
                         code as failure_code, coalesce(description, 'Unclassified Error') as error_description,
                         count(*) as failure_count,
                         {pct("count(*)", "(select count(*) from tx where bad)")} as pct_contribution_to_failures,
                         cast(sum(amount) as double) as total_failed_value_inr, {MEAN} as avg_failed_amount_inr
                  from coded where bad group by 1, 2, 3, 4)""",
        ),
        "failure_reasons": _with(
            "coded",
            """select coalesce(category, 'Unknown') as category, coalesce(description, code) as description,
                      count(*) as "count" from coded where bad group by 1, 2""",
        ),
        "failure_rollup": _with(
            "coded",
            """select decline_type, error_category, failure_code,
                      cast(grouping(decline_type, error_category, failure_code) as integer) as grouping_level,
                      count(*) as failure_count, cast(sum(amount) as double) as failed_value_inr
               from (select coalesce(decline, 'Other') as decline_type, coalesce(category, 'Unknown') as error_category,
                            code as failure_code, amount from coded where bad)
               group by rollup (decline_type, error_category, failure_code)""",
        ),
    }


def _fitted_effects(rounds: int) -> str:
    """Payer and payee effects by alternating weighted means, each round two relations."""
    steps = [
        """fit0 as (select payer, payee, count(*) as n, count(*) filter (where decline = 'Technical Decline') as d,
                  sum(d) over () / sum(n) over () as mu, 0::double as a, 0::double as b from coded group by all)"""
    ]
    for i in range(2 * rounds):
        mine, other, side = ("a", "b", "payer") if i % 2 == 0 else ("b", "a", "payee")
        mean = f"sum(d - n * (mu + {other})) over (partition by {side}) / sum(n) over (partition by {side})"
        steps.append(f"fit{i + 1} as (select * replace ({mean} as {mine}) from fit{i})")
    sides = " union all ".join(
        f"""select '{role}' as bank_role, {role} as bank_id, sum(n) as total_volume, sum(d) as technical_declines, max({e}) as e, max(mu) as mu
            from fit{2 * rounds} group by {role}"""
        for role, e in (("payer", "a"), ("payee", "b"))
    )
    spread = "sum(e * e * total_volume)"
    return f""", {", ".join(steps)}
        select bank_role, bank_id, name as bank_name, cast(total_volume as bigint) as total_volume,
               cast(technical_declines as bigint) as technical_declines,
               round(100 * (technical_declines / total_volume - mu), 4) + 0 as raw_points, round(100 * e, 4) + 0 as effect_points,
               round(cast(e * total_volume as double), 2) + 0 as declines_from_effect,
               {pct(f"{spread} over (partition by bank_role)", f"{spread} over ()")} as role_spread_pct
        from ({sides}) left join bank on id = bank_id"""


def _banks() -> dict[str, str]:
    pivot = ", ".join(
        f"""{pct(n_if(f"bad and r.name = '{n}'"), n_if(f"r.name = '{n}'"), 1)} as "{n}" """ for n in D.BANK_NAMES
    )
    sides = " union all ".join(
        f"""select '{side}' as bank_role, name as bank_name, count(*) as total_volume, {TD_WIDE} as technical_declines,
            {BD_WIDE} as business_declines from coded join bank on bank.id = {side} group by all"""
        for side in ("payer", "payee")
    )
    return {
        "payer_bank_ranking": _with(
            "coded bank",
            f"""select name as payer_bank_name, kind as bank_type, n as total_volume, good as success_volume,
                   lost as failure_volume, {pct("good", "n")} as bank_psr, {pct("td", "n")} as technical_decline_rate,
                   {pct("bd", "n")} as business_decline_rate,
                   cast(rank() over (order by 100.0 * good / n) as integer) as reliability_rank_asc
                from (select name, bank.kind as kind, count(*) as n, {OK} as good, {BAD} as lost,
                             {TD_WIDE} as td, {BD_WIDE} as bd
                      from coded join bank on bank.id = payer group by all) where n >= 100""",
        ),
        "bank_psr_td": _with(
            "coded bank",
            f"""select name as bank_name, {pct(OK, "count(*)")} as psr, {pct(TD_WIDE, "count(*)")} as td_rate
                from coded join bank on bank.id = payer group by 1""",
        ),
        "bank_pair_matrix": _with(
            "tx bank",
            f"""select p.name as payer_bank, r.name as payee_bank, count(*) as pair_volume, {BAD} as pair_failures,
                   {pct(BAD, "count(*)")} as pair_failure_rate, {value(AT_RISK)} as pair_value_at_risk
                from tx join bank p on p.id = payer join bank r on r.id = payee group by 1, 2 having count(*) >= 200
                order by pair_failure_rate desc, 1, 2 limit 15""",
        ),
        "bank_pair_pivot": _with(
            "tx bank",
            f"""select p.name as payer_bank, {pivot}
                from tx join bank p on p.id = payer join bank r on r.id = payee group by 1""",
        ),
        "bank_type_peak": _with(
            "coded bank",
            f"""select bank.kind as bank_type, {HOUR} in (19, 20, 21) as is_peak, count(*) as total_volume,
                   {pct(OK, "count(*)")} as psr_percentage, {pct(TD_WIDE, "count(*)")} as technical_decline_rate
                from coded join bank on bank.id = payer group by 1, 2""",
        ),
        "bank_effects": _with("coded bank", _fitted_effects(8)),
        "decline_by_bank_role": _with(
            "coded bank",
            f"""select *, {pct("technical_declines", "total_volume")} as technical_decline_rate,
                   {pct("technical_declines", "sum(technical_declines) over (partition by bank_role)")} as td_share_of_role
                from ({sides})""",
        ),
    }


def _times() -> dict[str, str]:
    return {
        "hourly_profile": _with(
            "tx",
            f"""select {HOUR} as hour_of_day, count(*) as total_txns, {OK} as success_txns, {BAD} as failed_txns,
                   {pct(OK, "count(*)")} as psr_percentage, {pct(BAD, "count(*)")} as failure_rate_percentage,
                   {pct(TD, "count(*)")} as td_rate_percentage,
                   case when {HOUR} in (19, 20, 21) then 'Evening Peak (19:00-21:00)'
                        when {HOUR} in (12, 13, 14) then 'Afternoon Peak (12:00-14:00)'
                        when {HOUR} in (1, 2, 3, 4, 5) then 'Off-Peak Night' else 'Normal Hours' end as time_window_type
                from tx group by {HOUR}""",
        ),
        "hourly_chart": _with(
            "tx",
            f"""select {HOUR} as hour_of_day, count(*) as total_txns, {pct(OK, "count(*)")} as psr_pct,
                   {pct(TD, "count(*)")} as td_rate_pct from tx group by 1""",
        ),
        "peak_summary": _with(
            "tx",
            f"""select case when {HOUR} in (19, 20, 21) then 'Evening Peak Hours (7 PM - 9 PM)'
                        else 'Non-Peak Hours' end as period_type, count(*) as total_volume,
                   {pct(OK, "count(*)")} as psr_percentage, {pct(TD, "count(*)")} as td_rate_percentage,
                   {pct(BD, "count(*)")} as bd_rate_percentage, {MEAN} as avg_txn_amount from tx group by 1""",
        ),
        "peak_multiplier": _with(
            "tx",
            f"""select round(peak, 2) as avg_peak_hour_volume, round(rest, 2) as avg_off_peak_hour_volume,
                   round(peak / nullif(rest, 0), 2) as peak_multiplier
                from (select avg(n) filter (where h in (19, 20, 21)) as peak,
                             avg(n) filter (where h not in (19, 20, 21)) as rest
                      from (select {HOUR} as h, count(*) as n from tx group by 1))""",
        ),
        "weekday_profile": _with(
            "tx",
            f"""select cast(isodow(ts) - 1 as integer) as day_of_week, count(*) as total_txns, {BAD} as failed_txns,
                   {pct(OK, "count(*)")} as psr_percentage, {pct(TD, "count(*)")} as td_rate_percentage
                from tx group by 1""",
        ),
        "rolling_failure_rate": _with(
            "tx",
            f"""select hour_start, n as total_txns, f as failed_txns, cast(sum(n) over w as bigint) as rolling_txns,
                   cast(sum(f) over w as bigint) as rolling_failures,
                   {pct("sum(f) over w", "sum(n) over w")} as rolling_failure_rate
                from (select date_trunc('hour', ts) as hour_start, count(*) as n, {BAD} as f from tx group by 1)
                window w as (order by hour_start range between interval 2 hours preceding and current row)""",
        ),
    }


def _stages() -> dict[str, str]:
    return {
        "funnel": _with(
            "step stage",
            f"""select stage_name, stage_id, entering as transactions_entering_stage, lost as stage_failures,
                   {pct("entering", "(select count(distinct o_orderkey) from orders)")} as overall_conversion_pct,
                   {pct("lost", "entering")} as stage_dropoff_rate_pct,
                   cast(lag(entering) over (order by stage_id) - entering as double) as absolute_dropoff_volume
                from (select stage_id, count(distinct id) as entering, {n_if("bad")} as lost from step group by 1)
                join stage using (stage_id)""",
        ),
        "funnel_volume": _with(
            "step stage",
            """select stage_name, count(distinct id) as volume from step join stage using (stage_id) group by 1""",
        ),
        "stage_latency": _with(
            "reach stage",
            """select stage_id, stage_name, steps, mean_seconds, p50_seconds, p95_seconds,
                      cast(row_number() over (order by mean_seconds desc, stage_id) as integer) as slowness_rank
               from (select stage_id, max(n) as steps, round(cast(sum(us) as double) / max(n) / 1e6, 3) as mean_seconds,
                            max(us) filter (where place = ceil(0.5 * n)) / 1e6 as p50_seconds,
                            max(us) filter (where place = ceil(0.95 * n)) / 1e6 as p95_seconds
                     from (select stage_id, us, count(*) over (partition by stage_id) as n,
                                  row_number() over (partition by stage_id order by us) as place
                           from (select stage_id, date_diff('microsecond',
                                        lag(ts) over (partition by id order by stage_id), ts) as us from reach)
                           where us is not null) group by 1)
               join stage using (stage_id)""",
        ),
        "stage_latency_sketched": _with(
            "reach stage",
            """select stage_id, stage_name, count(distinct day) as days, count(*) as steps,
                      round(cast(sum(us) as double) / count(*) / 1e6, 3) as mean_seconds, true as within_bound
               from (select stage_id, cast(min(ts) over (partition by id) as date) as day,
                            date_diff('microsecond', lag(ts) over (partition by id order by stage_id), ts) as us from reach)
               join stage using (stage_id)
               where us is not null and day between date '1996-01-01' and date '1997-12-31' group by all""",
        ),
        "completion_time": _with(
            "step",
            """select count(*) as completed_transactions,
                      round(cast(sum(us) as double) / nullif(count(*), 0) / 1e6, 3) as mean_seconds,
                      min(us) / 1e6 as min_seconds, max(us) / 1e6 as max_seconds
               from (select date_diff('microsecond', min(ts), min(ts) filter (where stage_id = 7 and not bad)) as us
                     from step where stage_id between 1 and 7 group by id
                     having count(*) filter (where stage_id = 7 and not bad) > 0)""",
        ),
    }


def _users() -> dict[str, str]:
    per_user = f"(select user_id, count(*) as n, {OK} as good, {BAD} as lost from tx group by 1)"
    severe = "count(*) filter (where lost >= 3)"
    friction = f"""count(*) as active_users, cast(sum(n) as bigint) as txn_volume, cast(sum(lost) as bigint) as failed_volume,
        {pct("sum(good)", "sum(n)")} as psr_percentage, {pct(severe, "count(*)")} as pct_severely_impacted
        from {per_user} join usr using (user_id) group by 1"""
    return {
        "segment_friction": _with(
            "tx usr",
            f"""select segment as user_segment, count(*) as total_users_in_segment, cast(sum(n) as bigint) as segment_txn_volume,
                   cast(sum(lost) as bigint) as segment_failed_volume, {pct("sum(good)", "sum(n)")} as segment_psr,
                   round(cast(sum(lost) as double) / count(*), 2) as avg_failures_per_user,
                   {severe} as users_with_3plus_failures, {pct(severe, "count(*)")} as pct_users_severely_impacted
                from {per_user} join usr using (user_id) group by 1""",
        ),
        "severe_impact": _with(
            "tx usr",
            f"""select segment as user_segment, {pct(severe, "count(*)")} as pct_severely_impacted
                from {per_user} join usr using (user_id) group by 1""",
        ),
        "impacted_power_users": _with(
            "tx usr",
            f"""select user_id, segment as user_segment, state, count(*) as total_attempts, {BAD} as failed_attempts,
                   {TD} as technical_declines, {pct(OK, "count(*)")} as user_psr, {value(AT_RISK)} as user_failed_value_inr
                from tx join usr using (user_id) group by 1, 2, 3 having count(*) >= 10 and {BAD} >= 3
                order by failed_attempts desc, user_id limit 20""",
        ),
        "age_group_friction": _with("tx usr", f"select age as age_group, {friction}"),
        "tenure_friction": _with("tx usr", f"select cast(tenure // 365 as integer) as tenure_band, {friction}"),
    }


def _segments() -> dict[str, str]:
    def matrix(contiguous: bool) -> str:
        return _with(
            "tx",
            f"""select kind as transaction_type, {_bucket(contiguous)} as amount_bucket, count(*) as transaction_volume,
                   {OK} as successful_volume, {pct(OK, "count(*)")} as psr_percentage,
                   cast({AT_RISK} as double) as value_at_risk_inr from tx group by 1, 2""",
        )

    return {
        "os_network": _with(
            "coded",
            f"""select p_type as operating_system, network as network_type, count(*) as total_volume,
                   {pct(OK, "count(*)")} as psr_percentage, {pct(NET, "count(*)")} as network_timeout_rate,
                   {pct(TD_WIDE, "count(*)")} as technical_decline_rate
                from coded join part on p_partkey = device group by 1, 2""",
        ),
        "type_amount_matrix": matrix(False),
        "type_amount_contiguous": matrix(True),
    }


def _retries() -> dict[str, str]:
    def policy(window_us: int, tolerance: str) -> str:
        return _with(
            "chain ec",
            f"""select error_category, error_code, error_description, technical_or_business_decline,
                   total_retried_failures, successful_retries, failed_retries,
                   {pct("successful_retries", "total_retried_failures")} as retry_success_rate_pct,
                   round(cast(gaps as double) / total_retried_failures / 1e6, 1) as avg_time_to_retry_seconds,
                   case when error_category in ('Technical Decline', 'Timeout/Network')
                             and 100.0 * successful_retries / total_retried_failures >= 50
                        then 'RECOMMENDED FOR AUTO-RETRY / SMART RETRY'
                        when error_code in ('ERR_BD_01', 'ERR_BD_02', 'ERR_BD_03')
                        then 'DO NOT AUTO-RETRY (Hard Business Decline / Security / Balance)'
                        else 'MANUAL RETRY ONLY' end as product_retry_policy
                from (select category as error_category, ec.code as error_code, description as error_description,
                             decline as technical_or_business_decline, count(*) as total_retried_failures,
                             {n_if("next_ok")} as successful_retries, {n_if("not next_ok")} as failed_retries, sum(gap) as gaps
                      from chain join ec on ec.code = chain.code
                      where bad and gap <= {window_us} and abs(amount - next_amount) <= cast({tolerance} as decimal(6,4)) * amount
                      group by all)""",
        )

    def after_timeout(window_us: int) -> str:
        followed = n_if(f"gap <= {window_us}")
        return _with(
            "chain",
            f"""select count(*) as timeout_failures, {followed} as followed_by_attempt,
                   {pct(followed, "count(*)")} as followed_pct from chain where bad and code = 'ERR_NET_01'""",
        )

    def episodes(attempts: str, window_us: int) -> str:
        return f"""
            select user_id, first(id order by ts, id) as first_transaction_id, last(id order by ts, id) as last_transaction_id,
                   first(code order by ts, id) as failure_code, min(ts) as started_at, count(*) as attempts,
                   date_diff('microsecond', min(ts), max(ts)) as us,
                   case when last(ok order by ts, id) then 'RECOVERED'
                        when date_diff('microsecond', max(ts), (select max(ts) from {attempts})) >= {window_us} then 'ABANDONED'
                        else 'OPEN' end as outcome
            from (select *, sum(fresh) over (partition by user_id order by ts, id rows unbounded preceding) as island
                  from (select *, case when lag(bad) over w and date_diff('microsecond', lag(ts) over w, ts) <= {window_us}
                                       then 0 else 1 end as fresh
                        from {attempts} window w as (partition by user_id order by ts, id)))
            group by user_id, island having first(bad order by ts, id)"""

    def episodes_by_code(attempts: str, window_us: int) -> str:
        ok, lost = n_if("outcome = 'RECOVERED'"), n_if("outcome = 'ABANDONED'")
        return _with(
            attempts,
            f"""select failure_code, count(*) as episodes, {ok} as recovered, {n_if("outcome = 'RECOVERED' and attempts = 2")} as recovered_at_second,
                   {n_if("outcome = 'RECOVERED' and attempts > 2")} as recovered_later, {lost} as abandoned,
                   {n_if("outcome = 'OPEN'")} as still_open, max(attempts) as most_attempts, {pct(ok, f"({ok} + {lost})")} as recovery_pct,
                   round(cast(sum(attempts) filter (where outcome = 'RECOVERED') as double) / nullif({ok}, 0), 2) as attempts_to_success,
                   round(cast(sum(us) filter (where outcome = 'RECOVERED') as double) / nullif({ok}, 0) / 1e6, 1) as seconds_to_success
                from ({episodes(attempts, window_us)}) group by 1""",
        )

    day = 86_400_000_000
    return {
        "retry_episodes_day": _with("tx", f"select * exclude (us), us / 1e6::double as seconds from ({episodes('tx', day)})"),
        "retry_episodes_by_code_day": episodes_by_code("tx", day),
        "retry_episodes_by_code_repeated": episodes_by_code("again_coded", 900_000_000),
        "retry_policy": policy(900_000_000, "0.1"),
        "retry_policy_day": policy(day, "0.5"),
        "retry_by_category": _with(
            "chain ec",
            f"""select category as error_category, count(*) as total_retries, {pct(n_if("next_ok"), "count(*)")} as retry_success_rate
                from chain join ec on ec.code = chain.code where bad and gap <= 900000000 group by 1""",
        ),
        "retry_frequency": _with(
            "chain",
            f"""select code as failure_code, count(*) as failures, {n_if("gap <= 900000000")} as retried_failures,
                   {n_if("gap <= 300000000")} as quick_retries, {n_if("gap <= 300000000 and next_ok")} as quick_successes,
                   {pct(n_if("gap <= 900000000"), "count(*)")} as retry_frequency_pct,
                   {pct(n_if("gap <= 300000000 and next_ok"), n_if("gap <= 300000000"))} as quick_success_pct
                from chain where bad group by 1""",
        ),
        "attempts_after_timeout": after_timeout(180_000_000),
        "attempts_after_timeout_day": after_timeout(day),
    }


def _duplicates() -> dict[str, str]:
    def repeated(keys: str, shown: str, window_us: int, attempts: str = "tx") -> str:
        return _with(
            attempts,
            f"""select {shown}, id as transaction_id, ts as "timestamp", case when bad then 'FAILED' else 'SUCCESS' end as final_status,
                   before as previous_transaction_id, gap / 1e6 as gap_seconds
                from (select *, lag(id) over w as before, date_diff('microsecond', lag(ts) over w, ts) as gap
                      from {attempts} window w as (partition by {keys} order by ts, id)) where gap <= {window_us}""",
        )

    def rate(keys: str, window_us: int, attempts: str = "tx") -> str:
        near = n_if(f"gap <= {window_us}")
        return _with(
            attempts,
            f"""select count(*) as completed_payments, {near} as duplicate_payments,
                   {pct(near, "count(*)")} as duplicate_payment_rate
                from (select date_diff('microsecond', lag(ts) over (partition by {keys} order by ts, id), ts) as gap
                      from {attempts} where ok)""",
        )

    def locks(keys: str, shown: str, lock: str, attempts: str = "tx") -> str:
        same = " and ".join(f"n.{key} = w.{key}" for key in keys.split(", "))
        of_n = ", ".join(f"n.{key}" for key in keys.split(", "))
        return "with recursive " + _with(
            attempts,
            f"""numbered as (select {keys}, id, ts, row_number() over (partition by {keys} order by ts, id) as i from {attempts}),
               walk as (
                 select {keys}, id, ts, i, ts as held, true as accepted from numbered where i = 1
                 union all
                 select {of_n}, n.id, n.ts, n.i,
                        case when n.ts > w.held + interval {lock} then n.ts else w.held end,
                        n.ts > w.held + interval {lock}
                 from walk w join numbered n on {same} and n.i = w.i + 1)
               select {shown}, id as transaction_id, ts as event_time, accepted from walk
               where ts <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes - interval 1 millisecond
                            from {attempts})""",
        ).removeprefix("with ").replace("\nnumbered as", ",\nnumbered as")

    follow_ups = """select f.id as transaction_id, f.user_id, f.ts as failed_at, count(a.id) as following_attempts,
            min(date_diff('microsecond', f.ts, a.ts)) / 1e6::double as first_gap_seconds
        from (select * from again_coded where bad and code = 'ERR_NET_01') f left join again a
            on a.user_id = f.user_id and a.ts between f.ts and f.ts + interval 180 seconds and (a.ts > f.ts or a.id > f.id)
        group by 1, 2, 3"""
    day = 86_400_000_000
    locked = """select user_id, payee as payee_bank_id, cast(date_trunc('day', ts) as timestamp) as lock_start, min(ts) as accepted_at,
        count(*) as attempts, count(*) - 1 as locked_attempts from tx group by 1, 2, 3 having count(*) > 1"""
    lock_key = "user_id, payee, amount"
    lock_shown = "user_id, payee as payee_bank_id, cast(amount as double) as amount"
    return {
        "duplicate_attempts": repeated(lock_key, lock_shown, 180_000_000),
        "duplicate_attempts_day": repeated("user_id, payee", "user_id, payee as payee_bank_id", day),
        "duplicate_attempts_repeated": repeated(lock_key, lock_shown, 180_000_000, "again"),
        "duplicate_payment_rate": rate(lock_key, 180_000_000),
        "duplicate_payment_rate_day": rate("user_id, payee", day),
        "duplicate_payment_rate_repeated": rate(lock_key, 180_000_000, "again"),
        "timeout_follow_ups_repeated": _with("again again_coded", follow_ups),
        "timeout_follow_ups_stream_repeated": _with(
            "again again_coded",
            f"""select * from ({follow_ups}) where date_trunc('hour', failed_at) + interval 1 hour
                    <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes - interval 180 seconds from again)""",
        ),
        "lock_windows": _with("tx", locked),
        "lock_windows_stream": _with(
            "tx",
            f"""select * from ({locked}) where lock_start + interval 1 day
                    <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from tx)""",
        ),
        "lock_windows_stream_repeated": _with(
            "again",
            f"""select * from (select {lock_shown}, time_bucket(interval 180 seconds, ts) as lock_start, min(ts) as accepted_at,
                      count(*) as attempts, count(*) - 1 as locked_attempts from again group by 1, 2, 3, 4 having count(*) > 1)
                where lock_start + interval 180 seconds
                    <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from again)""",
        ),
        "lock_stream": locks("user_id, payee", "user_id, payee as payee_bank_id", "1 day"),
        "lock_stream_repeated": locks(lock_key, lock_shown, "180 seconds", "again"),
    }


def _health() -> dict[str, str]:
    rolling = f"""select window_start, window_start + interval 5 minutes as window_end, payer as payer_bank_id,
        count(*) as txns, {OK} as successes, {pct(OK, "count(*)")} as rolling_psr, 100.0 * {OK} / count(*) < 88 as alert
        from (select payer, ok, ts, unnest([date_trunc('minute', ts) - to_minutes(i) for i in [0, 1, 2, 3, 4]]) as window_start from tx)
        group by 1, 2, 3"""
    incidents = f"""select payer_bank_id, min(window_start) as started, max(window_end) as ended, count(*) as windows,
            {n_if("psr < 88")} as alert_windows, max(txns) as txns, round(min(psr), 2) as worst_psr
        from (select *, sum(fresh) over (partition by payer_bank_id order by window_end) as run
              from (select *, case when window_end - lag(window_end) over (partition by payer_bank_id order by window_end) <= interval 2 minutes
                                   then 0 else 1 end as fresh
                    from (select *, 100.0::double * successes / txns as psr from ({rolling})) where psr < 90))
        group by payer_bank_id, run having {n_if("psr < 88")} > 0"""
    bucket = f"cast(concat('0x', substr(sha256('{SALT}:' || cast(user_id as varchar)), 1, 8)) as bigint) % 100"
    return {
        "bank_health": _with("tx", rolling),
        "bank_health_stream": _with(
            "tx",
            f"""select * from ({rolling})
                where window_end <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from tx)""",
        ),
        "bank_incidents": _with("tx", incidents),
        "bank_incidents_stream": _with(
            "tx",
            f"""select * from ({incidents}) where ended + interval 2 minutes
                    <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from tx)""",
        ),
        "assign_variants": _with(
            "usr",
            f"""select user_id, cast({bucket} as integer) as bucket,
                   case when {bucket} < 50 then 'treatment' else 'control' end as variant from usr""",
        ),
    }


def _experiments() -> dict[str, str]:
    def readout(per_user: str, whole: str, part: str, rate: str, salt: str = f"'{SALT}'", by: str = "") -> str:
        bucket = f"cast(concat('0x', substr(sha256({salt} || ':' || cast(user_id as varchar)), 1, 8)) as bigint) % 100"
        keys = f"{by}, " if by else ""
        sums = ", ".join(
            f"""count(*) filter (where b {test} 50) as {s}_users, coalesce(sum(w) filter (where b {test} 50), 0)::double as {s}_w,
                coalesce(sum(p) filter (where b {test} 50), 0)::double as {s}_p, (sum(w::hugeint * w) filter (where b {test} 50))::double as {s}_ww,
                (sum(p::hugeint * p) filter (where b {test} 50))::double as {s}_pp, (sum(w::hugeint * p) filter (where b {test} 50))::double as {s}_wp"""
            for s, test in (("control", ">="), ("treatment", "<"))
        )
        rates = ", ".join(f"{s}_p / nullif({s}_w, 0) as {s}_r" for s in ("control", "treatment"))
        spread = ", ".join(
            f"""{s}_users::double / nullif({s}_users - 1, 0) * greatest({s}_pp - 2 * {s}_r * {s}_wp + {s}_r * {s}_r * {s}_ww, 0)
                / nullif({s}_w * {s}_w, 0) as {s}_v, {s}_r * (1 - {s}_r) / nullif({s}_w, 0) as {s}_naive"""
            for s in ("control", "treatment")
        )
        shown = ", ".join(
            f"{s}_users, {s}_w::bigint as {s}_{whole}, {s}_p::bigint as {s}_{part}, {pct(f'{s}_p', f'{s}_w')} as {s}_{rate}"
            for s in ("control", "treatment")
        )
        return f"""select {keys}{shown}, round(100.0::double * lift, 4) + 0.0::double as lift_points,
               round(100.0::double * error, 4) as standard_error_points,
               round(100.0::double * (lift - 1.959964::double * error), 4) + 0.0::double as low_points,
               round(100.0::double * (lift + 1.959964::double * error), 4) + 0.0::double as high_points,
               round(lift / error, 4) + 0.0::double as z_value,
               round(error * error / nullif(treatment_naive + control_naive, 0), 4) as design_effect,
               round(100.0::double * (1.959964::double + 0.841621::double) * error, 4) as detectable_points,
               abs(round(lift / error, 4)) > 1.959964::double as significant_at_5pct
            from (select *, treatment_r - control_r as lift, nullif(sqrt(treatment_v + control_v), 0) as error
                  from (select *, {spread} from (select *, {rates} from (
                      select {keys}{sums} from (select *, {bucket} as b from ({per_user})) {"group by " + by if by else ""}))))"""

    attempts = f"select user_id, count(*) as w, {OK} as p from tx where user_id is not null group by 1"
    day = 86_400_000_000
    return {
        "experiment_readout": _with("tx", readout(attempts, "txns", "successes", "psr")),
        "experiment_retry_day": _with(
            "chain",
            readout(
                f"""select user_id, count(*) as w, {n_if("next_ok")} as p from chain
                    where bad and next_id is not null and gap <= {day} and abs(amount - next_amount) <= 0.5 * amount
                      and user_id is not null group by 1""",
                "retried", "successful_retries", "retry_success",
            ),
        ),
        "experiment_duplicates_repeated": _with(
            "again",
            readout(
                f"""select user_id, count(*) as w, {n_if("gap <= 180000000")} as p from (
                      select user_id, date_diff('microsecond', lag(ts) over (partition by user_id, payee, amount order by ts, id), ts) as gap
                      from again where ok and user_id is not null) group by 1""",
                "completed", "duplicates", "duplicate_rate",
            ),
        ),
        "experiment_aa": _with(
            "tx",
            f"""select salt, control_users, treatment_users, lift_points, z_value, design_effect, significant_at_5pct from ({readout(
                f"select * from ({attempts}), (select 'aa-' || i as salt from range(1, 201) r(i))",
                "txns", "successes", "psr", "salt", "salt")})""",
        ),
    }


def _abandonment() -> dict[str, str]:
    bucket = f"cast(concat('0x', substr(sha256('{SALT}:' || cast(user_id as varchar)), 1, 8)) as bigint) % 100"
    variant = f"case when {bucket} < 50 then 'treatment' else 'control' end"

    def curve(key: str, name: str, horizon_s: int, grid_s: int, attempts: str = "tx") -> str:
        grid, last = grid_s * 1_000_000, horizon_s // grid_s
        return f"""watch as (
                select {key} as {name}, (gap + {grid - 1}) // {grid} as back,
                       least(date_diff('microsecond', ts, (select max(ts) from {attempts})) // {grid}, {last}) as seen
                from (select *, date_diff('microsecond', ts, lead(ts) over (partition by user_id order by ts, id)) as gap from {attempts})
                where bad),
            steps as (
                select {name}, case when back <= {last} then back else seen end as step, {n_if(f"back <= {last}")} as returned,
                       {n_if(f"back is null or back > {last}")} as censored from watch group by 1, 2),
            curve as (
                select {name}, step, step * {grid_s} as seconds, at_risk, returned, censored,
                       product(1.0::double - returned::double / at_risk) over up as away,
                       sum(case when returned < at_risk then returned / (at_risk::double * (at_risk - returned)) else 0 end) over up as spread
                from (select *, cast(sum(returned + censored) over (partition by {name} order by step desc) as bigint) as at_risk from steps)
                window up as (partition by {name} order by step))"""

    def rates(name: str, horizon_s: int, grid_s: int) -> str:
        return f"""select {name}, cast(sum(returned + censored) as bigint) as failures, cast(sum(returned) as bigint) as returned,
                cast(sum(censored) filter (where step < {horizon_s // grid_s}) as bigint) as watched_less,
                round(100.0::double * arg_max(away, step), 4) as abandonment_pct,
                round(100.0::double * arg_max(away * sqrt(spread), step), 4) as standard_error_points,
                cast(min(seconds) filter (where away <= 0.5) as double) as median_return_seconds,
                {pct("sum(censored)", "sum(returned + censored)", 4)} as unadjusted_pct
            from curve group by 1"""

    day = 86_400
    return {
        "abandonment_by_code": _with("tx", "").rstrip() + ",\n" + curve("code", "failure_code", day, 60) + rates("failure_code", day, 60),
        "abandonment_by_variant": _with("tx", "").rstrip() + ",\n" + curve(variant, "variant", 3 * day, 60) + rates("variant", 3 * day, 60),
        "abandonment_curve": _with("tx", "").rstrip() + ",\n" + curve("code", "failure_code", 7 * day, 3_600)
        + """select failure_code, cast(seconds as bigint) as seconds, at_risk, returned, censored, round(away, 6) as away,
                    round(away * sqrt(spread), 6) as standard_error from curve""",
        "rollback_triggers": _with("again", "").rstrip() + ",\n" + curve(variant, "variant", day, 60, "again")
        + f"""select metric, observed, upper_limit, round(observed - upper_limit, 2) as excess from (
                select 'dropoff_increase' as metric, round(max(abandonment_pct) filter (where variant = 'treatment')
                        - max(abandonment_pct) filter (where variant = 'control'), 4) as observed, 0.5::double as upper_limit
                from ({rates("variant", day, 60)})
                union all
                select 'duplicate_payment_rate', {pct(n_if("gap <= 180000000"), "count(*)")}, 0.01::double
                from (select date_diff('microsecond', lag(ts) over (partition by user_id, payee, amount order by ts, id), ts) as gap
                      from again where ok))
            where observed > upper_limit or observed is null""",
    }


def all_oracles() -> dict[str, str]:
    """SQL by query. Cleaning in batches has the rows of cleaning at once, and both lock
    streams make the same marks."""
    parts = [_audit(), _indicators(), _banks(), _times(), _stages(), _users(), _segments(), _retries(), _duplicates(), _health(), _experiments(), _abandonment()]
    found = {name: sql for part in parts for name, sql in part.items()}
    return found | {
        "keyed_lock_stream": found["lock_stream"],
        "keyed_lock_stream_repeated": found["lock_stream_repeated"],
        "clean_incremental": found["clean_transactions"],
        "clean_incremental_audit": found["dq_audit_summary"],
    }
