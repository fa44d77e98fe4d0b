"""Independent SQL for the registered queries (DuckDB dialect, base tables only)."""

from __future__ import annotations

from tallybook.functions import rules, text
from tallybook.plans import queries as q

# Statement rows, as in the fixture.
_STMT = """
stmt as (
  select {account} as account, cast(l_shipdate as date) as date,
    concat(
      case l_orderkey % 8 when 0 then 'PAIEMENT CB ' when 1 then 'VIR SEPA '
        when 2 then 'RETRAIT DAB ' when 3 then 'PRELEVEMENT SEPA '
        when 4 then 'Transfer to ' when 5 then 'Refund ' when 6 then ''
        else 'Transfer to savings ' end,
      case l_suppkey % 10 when 0 then 'CARREFOUR' when 1 then 'UBER EATS'
        when 2 then 'SNCF' when 3 then 'NETFLIX' when 4 then 'AMAZON MARKETPLACE'
        when 5 then 'PHARMACIE' when 6 then 'CINEMA UGC' when 7 then 'LOYER'
        when 8 then 'Frais bancaires' else 'EDF' end,
      ' ', p_name) as raw_description,
    case when l_returnflag = 'R' then l_extendedprice else -l_extendedprice end as amount,
    case l_linenumber % 2 when 0 then 'EUR' else 'usd' end as currency
  from lineitem
  join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
)"""

_SEGMENT, _MANY = "c_mktsegment", "concat('ACC-', o_custkey % 500)"


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _matches(column: str, pattern: str) -> str:
    """RE2 has no lookahead; three alternatives need a second test."""
    plain, extra = [], []
    for alternative in pattern.split("|"):
        word, _, ahead = alternative.partition("(?!")
        if not ahead:
            plain.append(alternative)
            continue
        avoid = ahead[:-1].removeprefix(".*")
        tail = f"regexp_replace({column}, '(?is)^.*{word}', '')"
        rest = "^" + avoid if ahead[:-1] == avoid else avoid
        extra.append(
            f"(regexp_matches({column}, '(?i){word}') and not regexp_matches({tail}, '(?i){rest}'))"
        )
    return " or ".join([f"regexp_matches({column}, {_lit('(?i)' + '|'.join(plain))})", *extra])


def _cascade(column: str, table: list[rules.Rule], otherwise: str) -> str:
    whens = " ".join(f"when {_matches(column, r.pattern)} then {_lit(r.label)}" for r in table)
    return f"case {whens} else {otherwise} end"


def _cleaned(raw: str) -> str:
    plain = f"regexp_replace({raw}, '[\\x00-\\x1f\\x7f]', ' ', 'g')"
    rest = f"trim(regexp_replace({plain}, {_lit('(?i)' + text.BANK_PREFIXES)}, ''))"
    return f"trim(regexp_replace(case when {rest} <> '' then {rest} else {plain} end, '\\s+', ' ', 'g'))"


_HASH = (
    "sha256(cast(date as varchar) || '|' || lower(raw_description) || '|' || "
    "printf('%.6f', amount) || '|' || account)"
)

_TX = f"""
tx as (
  select {_HASH} as transaction_id, date, {_cleaned('raw_description')} as description,
    raw_description, amount, upper(trim(currency)) as currency, 'Uncategorized' as category, account,
    {_cascade('raw_description', rules.TYPE_RULES, "'card_payment'")} as tx_type,
    regexp_matches(raw_description, {_lit('(?i)^(?:' + '|'.join(f'(?:{p})' for p in rules.INTERNAL_PATTERNS) + ')')}) as is_internal,
    cast(year(date) as integer) as year, cast(month(date) as integer) as month,
    cast(weekofyear(date) as integer) as week, cast(isodow(date) - 1 as integer) as day_of_week
  from stmt
)"""

_CAT = f"""
cat as (
  select t.*, m.label as rule_category from tx t join (
    select description, s, {_cascade('description', rules.CATEGORY_RULES, "case when s then 'Revenus' else 'Autre' end")} as label
    from (select distinct description, amount > 0 as s from tx)
  ) m on m.description = t.description and m.s = (t.amount > 0)
)"""


def _with(*ctes: str, account: str = _SEGMENT) -> str:
    return "with " + ",".join([_STMT.format(account=account), *ctes]) + "\n"


def _sum(where: str = "true", digits: int = 2, value: str = "amount") -> str:
    return f"cast(round(sum(cast({value} as decimal(18,6))) filter (where {where}), {digits}) as double)"


# Half-up mean in whole cents by integer arithmetic.
_MICRO = "sum(cast(cast(amount as decimal(18,6)) * 1000000 as hugeint))"
_MEAN = (
    f"cast(sign({_MICRO}) * ((2 * abs({_MICRO}) + count(*) * 10000) // (2 * count(*) * 10000)) / 100.0 as double)"
)

STMT, TX, CAT = _with(), _with(_TX), _with(_TX, _CAT)
MANY = _with(_TX, account=_MANY)

_LISTING = "transaction_id, date, description, amount, tx_type, account"
_EVENT = "transaction_id, date, description, amount, currency, category, tx_type, account"
_FULL = (
    "transaction_id, date, description, raw_description, amount, currency, category, account, "
    "tx_type, is_internal, year, month, week, day_of_week"
)
_RANGE = f"date between date '{q.START}' and date '{q.END}'"
_SPENT = "not is_internal and amount < 0"

_MONTHLY = f"""select account, year, month, printf('%04d-%02d', year, month) as period,
  {_sum('amount > 0')} as income, {_sum('amount < 0')} as expenses, {_sum()} as net,
  count(*) as tx_count from tx where {{where}} group by account, year, month"""

_MERCHANTS = f"""select description as merchant, count(*) as tx_count, {_sum()} as total, {_MEAN} as avg_tx,
  min(date) as first_seen, max(date) as last_seen from tx where {{where}} group by description"""


def _series(keys: str = "", where: str = "true", source: str = "tx") -> str:
    """CTEs totals, spine and series (gap-filled)."""
    k, on = (f"{keys}, ", f"s.{keys} = t.{keys} and ") if keys else ("", "")
    sk = f"s.{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""
totals as (
  select {k}date as ds, abs(sum(cast(amount as decimal(18,6)))) as y
  from {source} where {_SPENT} and {where} group by {k}date
),
spine as (
  select {k}cast(unnest(generate_series(min(ds), max(ds), interval 1 day)) as date) as ds from totals {group}
),
series as (
  select {sk}s.ds, coalesce(cast(t.y as double), 0.0) as y,
    row_number() over ({'partition by s.' + keys if keys else ''} order by s.ds) - 1 as x
  from spine s left join totals t on {on}s.ds = t.ds
)"""


def _forecast(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""
fit as (
  select {k}max(ds) as last_ds, count(*) as n, avg(y) as my, avg(x) as mx, stddev_pop(y) as sd,
    regr_sxy(y, x) / (regr_sxx(y, x) + 1) as slope
  from series {group}
),
steps as (
  select {k}last_ds, n, sd, step, greatest(0, my - slope * mx + slope * (n - 1 + step)) as yhat
  from (select *, unnest(generate_series(1, {q.HORIZON})) as step from fit where n >= 14)
),
ahead as (
  select {k}cast(last_ds + cast(step as integer) as date) as ds, yhat,
    greatest(0, yhat - sd) as yhat_lower, yhat + sd as yhat_upper from steps
)"""


_STATS = """
stats as (
  select description, count(*) as merchant_freq, cast(sum(cast(abs(amount) as decimal(18,6))) as double) / count(*) as merchant_mean,
    coalesce(stddev_samp(abs(amount)), 0) as merchant_std from {source} group by description
),
scored as (
  select t.*, merchant_freq, merchant_mean, merchant_std,
    least(5, greatest(-5, (abs(amount) - merchant_mean) /
      case when merchant_std < 1e-6 then 1 else merchant_std end)) as z
  from {source} t join stats s on s.description = t.description
)"""

_FEATURES = """
feats as (
  select transaction_id, ln(1 + abs(amount)) as log_amount, cast(sign(amount) as double) as sign,
    cast(day_of_week as double) as day_of_week_f, 8.0::double as hour_f,
    case when day_of_week >= 5 then 1.0::double else 0.0::double end as is_weekend,
    ln(1 + merchant_freq) as log_freq, z as amount_zscore, cast(month as double) as month_f
  from scored
)"""
_REAL_CTE = "\nreal_tx as (select * from tx where not is_internal)"
_FEATURE_NAMES = [
    "log_amount", "sign", "day_of_week_f", "hour_f", "is_weekend", "log_freq", "amount_zscore", "month_f",
]

_NGRAMS = """
docs as (select description, count(*) as n from tx group by description),
words as (
  select description, n, ' ' || w || ' ' as w
  from (select description, n, unnest(string_split_regex(lower(description), '\\s+')) as w from docs)
  where w <> ''
),
grams as (
  select description, n, substr(w, cast(i as integer), k) as term
  from (
    select description, n, w, k, unnest(generate_series(1, length(w) - k + 1)) as i
    from words, (values (2), (3), (4)) sizes(k) where length(w) > k
  )
  union all
  select description, n, w as term
  from words where length(w) <= 4
),
terms as (
  select term, cast(sum(tf * n) as bigint) as occurrences, cast(sum(n) as bigint) as documents
  from (select description, term, any_value(n) as n, count(*) as tf from grams group by description, term)
  group by term
)"""

def _margin(c: int) -> str:
    """The fixed weights of a label: its terms' share, sums of the numeric columns, intercept."""
    size, sign, day = [(0.3, -0.5, 0.05), (-0.2, 0.25, -0.1), (0.15, 1.0, 0.0), (-0.05, -0.75, 0.2)][c]
    intercept = [0.5, -0.25, 0.0, 0.125][c]
    return f"""coalesce(t{c}, 0.0) + cast({intercept} as double) + ln(1 + abs(amount)) * cast({size} as double)
      + sign(amount) * cast({sign} as double) + day_of_week * cast({day} as double) as m{c}"""


_MARGINS = f"""
vocab as (
  select term, idf, row_number() over (order by occurrences desc, term) - 1 as p
  from (select *, ln((1 + (select count(*) from tx)) / (1 + documents)) + 1 as idf from terms)
  qualify p < 3000
),
weighed as (
  select description, p, (1 + ln(tf)) * idf as v
  from (select description, term, count(*) as tf from grams group by description, term) join vocab using (term)
),
texts as (
  select description, {", ".join(f"sum(v * ((7 * p + 13 * {c}) % 11 - 5) / 4.0) / sqrt(sum(v * v)) as t{c}" for c in range(4))}
  from weighed group by description
),
margins as (
  select transaction_id, description, amount, {", ".join(_margin(c) for c in range(4))}
  from tx left join texts using (description)
),
topped as (select *, greatest(m0, m1, m2, m3) as top from margins),
raised as (select *, {", ".join(f"exp(m{c} - top) as e{c}" for c in range(4))} from topped)"""

# -- parsing fixtures --------------------------------------------------------

_KIND = "(length(raw_description) + dayofyear(date)) % {n}"
_DATE_CELLS = [
    "strftime(date, '%d/%m/%Y')", "strftime(date, '%Y-%m-%d')", "strftime(date, '%m/%d/%Y')",
    "strftime(date, '%d-%m-%Y')", "strftime(date, '%d.%m.%Y')", "strftime(date, '%Y/%m/%d')",
    "strftime(date, '%d/%m/%y')", "strftime(date, '%m/%d/%y')", "strftime(date, '%Y-%m-%d 00:00:00')",
    "strftime(date, '%Y-%m-%dT00:00:00')", "strftime(date, '%d/%m/%Y 00:00:00')",
    "strftime(date, '%m/%d/%Y 00:00:00')", "' '", "'31/02/2025'", "strftime(date, '%Y-%m-%d') || 'x'",
]
_STRPTIME = [
    "%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%d/%m/%y", "%m/%d/%y",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S",
]


def _case(kind: str, values: list[str]) -> str:
    return f"case {kind} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


# Layouts that share a slash or dash are tried in order; the year's width keeps them apart.
_PARSE_DATE = "coalesce(" + ", ".join(
    f"case when regexp_matches(trim(cell), '{'^' + f.replace('.', '[.]').replace('%Y', '[0-9]{4}').replace('%d', '[0-9]{1,2}').replace('%m', '[0-9]{1,2}').replace('%y', '[0-9]{2}').replace('%H', '[0-9]{1,2}').replace('%M', '[0-9]{1,2}').replace('%S', '[0-9]{1,2}') + '$'}') "
    f"then cast(try_strptime(trim(cell), '{f}') as date) end"
    for f in _STRPTIME
) + ")"

_SPLIT = f"""
cells as (
  select *, {_KIND.format(n=20)} as kind from stmt
),
parsed as (
  select account, lower(account) || '.csv' as source_file, kind, date,
    case when kind = 3 then '' else raw_description end as raw_description,
    cast(printf('%.2f', abs(amount)) as double) * case when amount > 0 then 1 else -1 end as amount,
    case when kind = 1 then 'missing date'
      when kind = 2 then 'unparseable date ''31/02/2025'''
      when kind = 4 then 'both debit and credit are empty/zero'
      when kind = 5 then 'unparseable amount ''12d''' end as reason
  from cells
)"""

_SPLIT_GOOD = f"""
good as (
  select {_HASH} as transaction_id, * from parsed where reason is null
)"""

_LAYOUTS = f"""
landed as (
  select date, raw_description, cast(printf('%.2f', amount) as double) as amount, 'joint' as account,
    case length(coalesce(account, '')) % 3 when 1 then upper(currency) when 2 then 'EUR' else 'USD' end as currency,
    case length(coalesce(account, '')) % 3 when 0 then 'Sale' else 'Uncategorized' end as category,
    case length(coalesce(account, '')) % 3 when 1 then 'revolut' when 2 then 'bnp' else 'chase' end as layout
  from stmt
),
ided as (select {_HASH} as transaction_id, * from landed),
joint as (
  select transaction_id, date, {_cleaned('raw_description')} as description, raw_description, amount,
    currency, category, account, layout,
    {_cascade('raw_description', rules.TYPE_RULES, "'card_payment'")} as tx_type,
    regexp_matches(raw_description, '(?i)^transfer to savings') as is_internal
  from ided
)"""

_HEADER_CASE = _case(f"s_suppkey % {len(q.HEADERS)}", [_lit(h) for h in q.HEADERS])
_NAME_CASE = _case(f"c_custkey % {len(q.FILE_NAMES)}", [_lit(n) for n in q.FILE_NAMES])

# Signature columns per layout for the array form of detection.
_SIGNATURES = [
    ("generic", ["date", "description", "amount"]),
    ("bnp", ["date", "libellé", "débit", "crédit"]),
    ("societe_generale", ["date de comptabilisation", "libellé", "débit", "crédit"]),
    ("credit_agricole", ["date", "libellé opération", "montant"]),
    ("revolut", ["started date", "description", "amount"]),
    ("n26", ["date", "payee", "amount (eur)"]),
    ("chase", ["transaction date", "description", "amount"]),
    ("bofa", ["date", "description", "amount"]),
]
_SIGNATURE_ROWS = ", ".join(
    f"({i}, {_lit(name)}, [{', '.join(_lit(c) for c in columns)}], {6 if name == 'bofa' else 0})"
    for i, (name, columns) in enumerate(_SIGNATURES)
)

_AMOUNT = "cast(printf('%.2f', abs(amount)) as double)"
_SIGNED = "cast(printf('%.2f', amount) as double)"

def _tree_depth(tree: int, node: int = 0) -> str:
    """The depth that a row reaches in a tree of the fixed forest, as nested cases."""
    if node >= 7:
        return str(3 + (5 * tree + node) % 9 / 4)
    column = (3 * tree + node) % 8
    cut = [9.5, 0.5, 2.5, 11.5, 0.5, 1.05, 0.755, 6.5][column]
    value = _FEATURE_NAMES[column] if column != 6 else f"round({_FEATURE_NAMES[column]}, 9)"
    return f"case when {value} <= {cut} then {_tree_depth(tree, 2 * node + 1)} else {_tree_depth(tree, 2 * node + 2)} end"


_FOREST = f"""walked as (
    select transaction_id, -pow(2.0, -({" + ".join(f"cast({_tree_depth(t)} as double)" for t in range(7))}) / 7
      / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0)) as score from feats),
  bounded as (select *, (select quantile_cont(score, 0.05) from walked) as threshold from walked),
  judged as (select transaction_id, round(score - threshold, 4) as anomaly_score, score < threshold as anomaly_flag,
    cast(rank() over (order by score) as bigint) as anomaly_rank from bounded)"""


ORACLE: dict[str, str] = {
    "clean_description": TX + "select transaction_id, raw_description, description from tx",
    "transaction_id": TX + "select account, date, raw_description, amount, transaction_id from tx",
    "currency_norm": STMT + f"""select account, code,
        case when length(trim(code)) = 3 then upper(trim(code)) else 'EUR' end as currency, count(*) as n_rows
      from (select account, {_case('length(raw_description) % 5', ["' eur'", "'usd '", "''", "'EURO'", "'gBp'"])} as code from stmt)
      group by all""",
    "flag_internal": TX + "select transaction_id, raw_description, is_internal from tx",
    "tx_type": TX + "select transaction_id, raw_description, tx_type from tx",
    "calendar_parts": TX + "select date, count(*) as n_rows, year, month, week, day_of_week from tx group by all",
    "enrich": TX + f"select {_FULL} from tx",
    "rule_category": CAT + "select transaction_id, description, amount, rule_category from cat",
    "format_money": TX + f"""select date, v as daily_net,
        case when v > 0 then '+' else '' end || replace(format('{{:,.2f}}', v), ',', ' ') || ' €' as label
      from (select date, {_sum()} as v from tx where not is_internal group by date)""",
    "parse_dates": STMT + f"""select cell, {_PARSE_DATE} as parsed, count(*) as n_rows
      from (select {_case(_KIND.format(n=len(_DATE_CELLS)), _DATE_CELLS)} as cell from stmt) group by all""",
    "parse_amounts": STMT + f"""select account, date, raw_description, cast(kind as integer) as kind,
        case when kind = 0 then {_SIGNED} when kind in (1, 3, 5) then {_AMOUNT}
          when kind in (2, 4) then -{_AMOUNT} when kind in (6, 7, 8, 9) then 0.0 end as dot_value,
        case when kind = 0 then {_SIGNED} when kind in (1, 3, 5) then {_AMOUNT}
          when kind in (2, 4) then -{_AMOUNT} when kind in (6, 7, 8, 9) then 0.0 end as comma_value
      from (select *, {_KIND.format(n=12)} as kind from stmt)""",
    "debit_credit": STMT + """select account, date, raw_description,
        case when amount < 0 then -amount else 0.0 end as debit,
        case when amount > 0 then amount else 0.0 end as credit, amount as signed from stmt""",
    "normalise": _with(_SPLIT, _SPLIT_GOOD) + f"""select transaction_id, date,
        case when raw_description = '' then 'Unknown' else {_cleaned('raw_description')} end as description,
        raw_description, amount, 'EUR' as currency, 'Uncategorized' as category, account, source_file
      from good""",
    "quarantine": _with(_SPLIT) + """select source_file, reason, count(*) as n_rows,
        min(raw_description) as first_text from parsed where reason is not null group by source_file, reason""",
    "ingest_metrics": _with(_SPLIT, _SPLIT_GOOD) + """select p.source_file, p.rows_read, p.rows_dropped,
        g.rows_after_dedup, g.row_warnings
      from (select source_file, count(*) as rows_read, count(reason) as rows_dropped from parsed group by source_file) p
      join (select source_file, count(distinct transaction_id) as rows_after_dedup,
              count(*) filter (where raw_description = '') as row_warnings from good group by source_file) g
        on g.source_file = p.source_file""",
    "dedup_first": TX + """select transaction_id, 'a.csv' as source_file, min(currency) as currency,
        min(description) as description, min(amount) as amount from tx group by transaction_id""",
    "profile_detect": f"""with rows as (select s_suppkey, {_HEADER_CASE} as header from supplier),
      aliased as (
        select *, string_split_regex(header, '[;,]') as cells,
          case when header = 'date;libelle;debit;credit' then ['date', 'libellé', 'débit', 'crédit']
            else string_split_regex(header, '[;,]') end as bnp_cells from rows
      ),
      signatures(place, profile, columns, skipped) as (values {_SIGNATURE_ROWS}),
      found as (
        select s_suppkey, header, place, profile, skipped, len(columns) as size,
          len(list_intersect(case when profile = 'bnp' then bnp_cells else cells end, columns)) as hits,
          len(list_intersect(case when profile = 'bnp' then bnp_cells else cells end, columns[1:2])) as must
        from aliased, signatures
      ),
      best as (
        select *, row_number() over (partition by s_suppkey
          order by hits / size desc, hits desc, skipped, place) as rn
        from found where hits >= 2 and must = 2
      )
      select r.s_suppkey, r.header, coalesce(b.profile, 'generic') as profile
      from rows r left join best b on b.s_suppkey = r.s_suppkey and b.rn = 1""",
    "profile_by_filename": f"""select c_custkey, file_name,
        case when f like '%revolut%' then 'revolut' when f like '%bnp%' then 'bnp'
          when f like '%societe%' or contains(f, 'sg_') then 'societe_generale'
          when contains(f, 'credit_agricole') or contains(f, 'ca_') then 'credit_agricole'
          when f like '%n26%' then 'n26' when f like '%chase%' then 'chase'
          when f like '%bofa%' or contains(f, 'bank_of_america') then 'bofa' else 'generic' end as profile
      from (select c_custkey, file_name, lower(file_name) as f
            from (select c_custkey, {_NAME_CASE} || c_custkey || '.csv' as file_name from customer))""",
    "scan_csv": TX + """select date, description, raw_description,
        cast(printf('%.2f', amount) as double) as amount, account as category, currency, 'all' as account from tx""",
    "multi_source_union": _with(_LAYOUTS) + """select transaction_id, any_value(date) as date,
        any_value(description) as description, any_value(raw_description) as raw_description,
        any_value(amount) as amount, arg_min(currency, layout) as currency,
        arg_min(category, layout) as category, any_value(account) as account
      from joint group by transaction_id""",
    "stream_ingest": _with(_LAYOUTS) + """select transaction_id, any_value(date) as date,
        any_value(description) as description, any_value(amount) as amount,
        arg_min(currency, layout) as currency, arg_min(category, layout) as category,
        any_value(tx_type) as tx_type, any_value(is_internal) as is_internal
      from joint group by transaction_id""",
    "merge_two_streams": _with(_LAYOUTS) + """select transaction_id, any_value(date) as date,
        any_value(description) as description, any_value(amount) as amount,
        arg_min(currency, layout) as currency, arg_min(category, layout) as category,
        any_value(tx_type) as tx_type, any_value(is_internal) as is_internal
      from joint group by transaction_id""",
    "scan_csv_quoted": STMT + """select date, raw_description || chr(10) || '"' || currency || '", x' as raw_description,
        cast(printf('%.2f', amount) as double) as amount, 0 as n_errors from stmt""",
    "scan_csv_records": STMT + """select date,
        raw_description || chr(10) || '"' || currency || '", x' || chr(10) || chr(10) || 'end' as raw_description,
        case when day(date) <> 13 then cast(printf('%.2f', amount) as double) end as amount,
        case when day(date) = 13 then 'too few cells' end as reason from stmt""",
    "scan_layouts": STMT + """select
        ['generic', 'bnp', 'societe_generale', 'credit_agricole', 'revolut', 'n26', 'chase', 'bofa'][1 + length(raw_description) % 8] as profile,
        date, raw_description, cast(printf('%.2f', amount) as double) as amount,
        case when length(raw_description) % 8 in (0, 4) then upper(currency)
          when length(raw_description) % 8 in (6, 7) then 'USD' else 'EUR' end as currency, 0 as n_errors from stmt""",
    "scan_encodings": STMT + """select date,
        raw_description || [' é€上', ' é', ' é€', ' é€上', ' é€上'][1 + length(raw_description) % 5] as raw_description,
        cast(printf('%.2f', amount) as double) as amount, 0 as n_errors from stmt""",
    "merge_new_rows": TX + f"""select transaction_id, min(date) as date, min(amount) as amount, min(year) as year,
        case when min(date) <= date '{q.FIRST_LOAD_UNTIL}' then 'first' else 'second' end as load_id
      from tx group by transaction_id""",
    "row_count": TX + "select count(distinct transaction_id) as n_rows from tx",
    "scan_real": TX + f"select distinct {_LISTING} from tx where not is_internal",
    "adhoc_sql": TX + f"""select account, tx_type, count(*) as n_rows, min(amount) as lowest, max(date) as latest
      from tx where {_SPENT} group by account, tx_type having count(*) > 10""",
    "sql_functions": _with(f"""
      named as (select *, {_cleaned('raw_description')} as description from stmt)""") + f"""
      select account, date, raw_description, amount,
        {_cascade('raw_description', rules.TYPE_RULES, "'card_payment'")} as tx_type,
        regexp_matches(raw_description, '(?i)^transfer to savings') as is_internal,
        {_cascade('description', rules.CATEGORY_RULES, "case when amount > 0 then 'Revenus' else 'Autre' end")} as category,
        {_HASH} as transaction_id,
        case when amount > 0 then '+' else '' end || replace(format('{{:,.2f}}', amount), ',', ' ') || ' €' as label
      from named""",
    "v_real": TX + f"select {_FULL} from tx where not is_internal",
    "v_expenses": TX + f"select {_LISTING} from tx where {_SPENT}",
    "v_income": TX + f"select {_LISTING} from tx where not is_internal and amount > 0",
    "expenses_month": TX + f"select {_EVENT} from tx where {_SPENT} and strftime(date, '%Y-%m') = '{q.MONTH}'",
    "income_month": TX + f"""select {_EVENT} from tx
      where not is_internal and amount > 0 and strftime(date, '%Y-%m') = '{q.MONTH}'""",
    "date_range": TX + f"select {_LISTING} from tx where {_RANGE}",
    "summary": TX + f"""select count(*) as total_tx, count(*) filter (where not is_internal) as real_tx,
        min(date) as first_date, max(date) as last_date,
        {_sum('amount > 0 and not is_internal')} as total_income,
        {_sum('amount < 0 and not is_internal')} as total_expenses,
        {_sum('not is_internal')} as net_balance, count(distinct account) as accounts from tx""",
    "monthly": TX + _MONTHLY.format(where="not is_internal"),
    "monthly_all": TX + _MONTHLY.format(where="true"),
    "v_monthly": TX + _MONTHLY.format(where="not is_internal"),
    "monthly_range": TX + f"""select * from ({_MONTHLY.format(where='not is_internal')})
      where period between '{str(q.START)[:7]}' and '{str(q.END)[:7]}'""",
    "top_merchants": TX + f"select * from ({_MERCHANTS.format(where=_SPENT)}) order by total, merchant limit 20",
    "top_merchants_all": TX + f"""select * from ({_MERCHANTS.format(where='not is_internal')})
      order by total, merchant limit 20""",
    "v_top_merchants": TX + f"select merchant, tx_count, total, avg_tx from ({_MERCHANTS.format(where=_SPENT)})",
    "merchant_spend": TX + f"""select merchant, tx_count, abs(total) as total_abs, abs(avg_tx) as mean_abs
      from ({_MERCHANTS.format(where=_SPENT + ' and ' + _RANGE)}) order by total, merchant limit 20""",
    "tx_types": TX + f"""select tx_type, count(*) as tx_count, {_sum()} as total
      from tx where not is_internal group by tx_type""",
    "daily_balance": TX + f"""select * from (
        select date, {_sum()} as daily_net,
          cast(round(sum(sum(cast(amount as decimal(18,6)))) over (order by date), 2) as double) as cumulative
        from tx where not is_internal group by date) where {_RANGE}""",
    "daily_balance_account": TX + f"""select account, date, {_sum()} as daily_net,
        cast(round(sum(sum(cast(amount as decimal(18,6)))) over (partition by account order by date), 2) as double) as cumulative
      from tx where not is_internal group by account, date""",
    "by_category": CAT + f"""select rule_category as category, abs({_sum()}) as total, count(*) as tx_count
      from cat where {_SPENT} and {_RANGE} group by rule_category""",
    "category_share": CAT + f"""select category, round(s / sum(s) over () * 100, 4) as share_pct
      from (select rule_category as category, cast(sum(cast(amount as decimal(18,6))) as double) as s
            from cat where {_SPENT} group by rule_category)""",
    "category_month_pivot": CAT + "select strftime(date, '%Y-%m') as period, " + ", ".join(
        f"coalesce(abs({_sum(f'rule_category = {_lit(c)}', 0)}), 0.0) as \"{c}\"" for c in q.reports.CATEGORIES
    ) + f" from cat where {_SPENT} group by period",
    "category_summary": CAT + f"""select rule_category as category, count(*) as tx_count, {_sum()} as total
      from cat where {_SPENT} group by rule_category""",
    "category_detail": CAT + f"""select date, description, amount, rule_category as category
      from cat where {_SPENT} and {_RANGE}""",
    "top_categories": CAT + f"""select rule_category as category, {_sum()} as total
      from cat where amount < 0 group by rule_category order by total, category limit 5""",
    "label_distribution": CAT + "select rule_category as category, count(*) as tx_count from cat group by rule_category",
    "daily_expense": _with(_TX, _series()) + "select ds, cast(round(y, 2) as double) as y from totals",
    "daily_series": _with(_TX, _series()) + "select ds, round(y, 2) as y from series",
    "daily_series_account": _with(_TX, _series(where=f"account = '{q.ACCOUNT}'"))
    + "select ds, round(y, 2) as y from series",
    "daily_series_excl": _with(_TX, _CAT, _series(where="rule_category not in ('Loyer', 'Virements')", source="cat"))
    + "select ds, round(y, 2) as y from series",
    "forecast_eligible": _with(_TX, _series("account"), account=_MANY)
    + "select account, count(*) as n_days, count(*) >= 14 as eligible from series group by account",
    "forecast_linear": _with(_TX, _series("account"), _forecast("account"), account=_MANY)
    + """select account, ds, round(yhat, 4) as yhat, round(yhat_lower, 4) as yhat_lower,
        round(yhat_upper, 4) as yhat_upper from ahead""",
    "forecast_summary": _with(_TX, _series(), _forecast())
    + """select ds as date, round(yhat, 2) as forecast, round(yhat_lower, 2) as lower,
        round(yhat_upper, 2) as upper from ahead""",
    "forecast_full": _with(_TX, _series(), _forecast())
    + """select ds, round(yhat, 4) as yhat, round(yhat_lower, 4) as yhat_lower, round(yhat_upper, 4) as yhat_upper
      from (select ds, y as yhat, y as yhat_lower, y as yhat_upper from series
            union all select ds, yhat, yhat_lower, yhat_upper from ahead)""",
    "forecast_monthly": _with(_TX, _series(), _forecast())
    + """select strftime(s.ds, '%Y-%m') as period,
        cast(round(coalesce(sum(t.y), 0), 2) as double) as total, false as is_forecast
      from spine s left join totals t on t.ds = s.ds group by 1
      union all
      select strftime(ds, '%Y-%m') as period, round(sum(yhat), 2) as total, true as is_forecast from ahead group by 1""",
    "merchant_freq": _with(_TX, _STATS.format(source="tx")) + "select transaction_id, merchant_freq from scored",
    "merchant_stats": _with(_TX, _STATS.format(source="tx"))
    + """select description, merchant_freq, merchant_mean,
        round(merchant_std, 4) as merchant_std from stats""",
    "amount_zscore": _with(_TX, _STATS.format(source="tx"))
    + "select transaction_id, round(z, 6) as amount_zscore from scored",
    "zscore_outliers": _with(_TX, _STATS.format(source="tx"))
    + "select transaction_id, description, amount from scored where abs(z) > 1.5",
    "anomaly_features": _with(_TX, _REAL_CTE, _STATS.format(source="real_tx"), _FEATURES)
    + "select transaction_id, " + ", ".join(f"round({c}, 6) as {c}" for c in _FEATURE_NAMES) + " from feats",
    "forest_scores": _with(_TX, _REAL_CTE, _STATS.format(source="real_tx"), _FEATURES, _FOREST)
    + "select transaction_id, anomaly_score, anomaly_flag, anomaly_rank from judged",
    "forest_top": _with(_TX, _REAL_CTE, _STATS.format(source="real_tx"), _FEATURES, _FOREST)
    + """select anomaly_rank, date, description, amount, currency, tx_type, account, anomaly_score
      from judged join real_tx using (transaction_id) where anomaly_flag order by anomaly_rank, transaction_id limit 20""",
    "flagged_share": _with(_TX, _REAL_CTE, _STATS.format(source="real_tx"), _FEATURES, _FOREST)
    + """select count(*) filter (anomaly_flag) as flagged, count(*) as scored,
      avg(cast(anomaly_flag as double)) as share from judged""",
    "standardise": _with(_TX, _REAL_CTE, _STATS.format(source="real_tx"), _FEATURES)
    + "select transaction_id, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () > 0 then stddev_pop({c}) over () else 1 end, 5) as {c}"
        for c in _FEATURE_NAMES
    ) + " from feats",
    "global_rank": TX + "select transaction_id, amount, rank() over (order by amount) as amount_rank from tx",
    "exact_quantile": TX + """select account, count(*) filter (where amount < c) as below, round(any_value(c), 6) as cut
      from tx, (select quantile_cont(amount, 0.05) as c from tx) group by account""",
    "lowest_k": TX + """select transaction_id, date, description, amount from tx
      order by amount, transaction_id limit 3""",
    "char_ngrams": _with(_TX, _NGRAMS) + "select term, occurrences, documents from terms",
    "tfidf_top_terms": _with(_TX, _NGRAMS) + """select term, occurrences, documents,
        round(ln((1 + (select count(*) from tx)) / (1 + documents)) + 1, 8) as idf
      from terms order by occurrences desc, term limit 3000""",
    "clf_features": TX + """select transaction_id, round(ln(1 + abs(amount)), 8) as log_amount,
        cast(sign(amount) as double) as sign, cast(day_of_week as double) as weekday_f from tx""",
    "weighted_categories": _with(_TX, _NGRAMS, _MARGINS) + """select transaction_id, description, amount,
        case top when m0 then 'Courses' when m1 then 'Loyer' when m2 then 'Revenus' else 'Transport' end
          as predicted_category from raised""",
    "weighted_probabilities": _with(_TX, _NGRAMS, _MARGINS) + "select transaction_id, " + ", ".join(
        f'round(e{c} / (e0 + e1 + e2 + e3), 6) as "{label}"'
        for c, label in enumerate(("Courses", "Loyer", "Revenus", "Transport"))
    ) + " from raised",
    "scalar_math": TX + """select transaction_id, abs(amount) as abs_amount, round(amount, 1) as rounded,
        round(ln(1 + abs(amount)), 8) as log_amount, cast(sign(amount) as double) as sign,
        least(50000.0, greatest(-50000.0, amount)) as clipped,
        case when amount > 0 then amount else 0.0 end as gain from tx""",
    "scalar_dates": STMT + f"""select date, count(*) as n_rows, strftime(date, '%Y-%m') as period,
        date + 45 as plus_45, date - 7 as minus_7, date - date '{q.START}' as days_since,
        day(date) as day_of_month, date as round_trip from stmt group by date""",
    "scalar_strings": STMT + """select raw_description, count(*) as n_rows, lower(raw_description) as lowered,
        upper(raw_description) as uppered, length(raw_description) as n_chars,
        replace(raw_description, ' ', '_') as underscored, starts_with(raw_description, 'VIR') as is_wire,
        ends_with(raw_description, 'ring') as is_ring,
        regexp_extract(raw_description, '^([A-Za-z]+)', 1) as first_word, sha256(raw_description) as digest,
        array_to_string(list_transform(string_split(lower(raw_description), ' '),
          lambda w: upper(w[1]) || w[2:]), ' ') as title
      from stmt group by raw_description""",
    "stream_daily_totals": """select cast(ts as date) as day, count(*) as event_count,
        cast(round(sum(cast(value as decimal(18,6))), 2) as double) as total_value from events group by 1""",
}
