"""Oracle SQL of the report text, over the oracle SQL of the reports."""

from __future__ import annotations

from collections.abc import Mapping

from tallymark.plans import render
from tallymark.plans import reports as R


def _dollars(c: str, digits: int = 2) -> str:
    return f"concat('$', format('{{:,.{digits}f}}', {c}))"


def _whole(c: str) -> str:
    return f"format('{{:,}}', CAST({c} AS BIGINT))"


def _percent(c: str) -> str:
    return f"format('{{:.2f}}%', {c})"


def _days(c: str) -> str:
    return f"concat({c}, ' Days')"


_FORMATS = {render.dollars: _dollars, render.whole: _whole, render.percent: _percent,
            render.days: _days}


def _text(line: str) -> str:
    return "'" + line.replace("'", "''") + "'"


def _row(label: str, value: str) -> str:
    return f"concat('| {label} | ', {value}, ' |')"


def _kpis(columns) -> list[str]:
    return [_row(render.KPI_ROWS[c][0], _FORMATS[render.KPI_ROWS[c][1]](c))
            for c in columns if c in render.KPI_ROWS]


def _list(*lines: str) -> str:
    return "[" + ", ".join(lines) + "]"


def deck_sql(oracle: Mapping[str, str], company: str, as_of: str) -> str:
    co = company.upper()
    weekly = [c for c in render.KPI_ROWS if c not in (
        "billed_ar", "billed_ar_pct", "unbilled_ar", "unbilled_ar_pct")]
    across = ", ".join(
        _row(label, f"string_agg({_FORMATS[fmt](c)}, ' | ' ORDER BY year)")
        for c, (label, fmt) in render.KPI_ROWS.items() if c in R.YEAR_COLUMNS)
    week = "concat('| Week ', week, ' | ', {}, ' | ', {}, ' |')"
    paid = week.format(_dollars("forecasted_collections"), _dollars("actual_collections"))
    seen = week.format(_whole("forecasted_visits"), _whole("actual_visits"))

    def denial_cells(mark: str) -> str:
        return (f"string_agg(concat(' ', '{mark}', COALESCE(n, 0), '{mark}', ' | ', '{mark}', "
                + _dollars("COALESCE(x, 0.0)") + f", '{mark}', ' |'), '' ORDER BY s.state)")

    return f"""
WITH bp AS ({oracle['billing_progress']}), wk AS ({oracle['weekly_kpis']}),
q AS ({oracle['latest_quarter']}), y AS ({oracle['yearly_kpis']}),
bd AS ({oracle['weekly_breakdown']}), cw AS ({oracle['client_week']}),
md AS ({oracle['month_to_date']}), ub AS ({oracle['unbilled_status_week']}),
top AS ({oracle['denial_top15']}), st AS ({oracle['denial_states']}),
cell AS (SELECT code, state, visit_count AS n, expected AS x FROM ({oracle['denial_by_state']})),
stt AS (SELECT state, visit_count AS n, expected AS x FROM ({oracle['denial_state_totals']})),
codes AS (SELECT t.code, t.total_visits, concat('| ', t.code, ' | ',
      trim(regexp_replace(t.sample_description, '^[^:]*:', '')), ' |', {denial_cells("")}) AS line
    FROM top t CROSS JOIN st s LEFT JOIN cell c ON c.code = t.code AND c.state = s.state
    GROUP BY t.code, t.total_visits, t.sample_description),
decks AS (
  SELECT 2 AS slide, {_list(
      f"concat('## SLIDE 2: {co} - BILLING PROGRESS (', month_label, ')')", "''",
      *map(_text, render.METRIC_VALUE), _row('Charges', _dollars('charges', 0)),
      _row('Encounters', _whole('encounters')),
      _row('Insurance Payments Posted', _dollars('insurance_payments', 0)),
      _row('Patient Payments Posted', _dollars('patient_payments', 0)),
      _row('A/R Claims processed', _whole('ar_claims_processed')),
      _row('Authorization denials/ Pending claims', _whole('auth_denials_pending')))} AS lines FROM bp
  UNION ALL SELECT 3, {_list(f"'## SLIDE 3: {co} - KPI METRICS WEEKLY'", "''",
                             *map(_text, render.TWO_COLUMNS), *_kpis(weekly))} FROM wk
  UNION ALL SELECT 4, {_list(
      f"concat('## SLIDE 4: {co} - KPI METRICS QUARTERLY (Q', quarter, ' ', year, ')')", "''",
      *map(_text, render.TWO_COLUMNS), *_kpis(R.QUARTER_COLUMNS))} FROM q
  UNION ALL SELECT 5, [{_text(f"## SLIDE 5: {co} - KPI METRICS YEAR OVER YEAR")}, '',
      {_row('Type', "string_agg(CAST(year AS VARCHAR), ' | ' ORDER BY year)")},
      concat('|------|', repeat('------|', CAST(COUNT(*) AS INT))), {across}] FROM y
  UNION ALL SELECT 6, list_concat(
      [concat('## SLIDE 6: {co} - WEEKLY BREAKDOWN (', MAX(month_name), ' ', MAX(year), ')'), '',
       '### Weekly Collections', '', {', '.join(map(_text, render.WEEK_HEAD))}],
      list({paid} ORDER BY week),
      ['', '### Weekly Visits', '', {', '.join(map(_text, render.WEEK_HEAD))}],
      list({seen} ORDER BY week)) FROM bd
  UNION ALL SELECT 7, {_list(
      f"concat('## SLIDE 7: {co} - CLIENT SUMMARY WEEKLY (', week_start, ' - ', week_end, ')')", "''",
      *map(_text, render.METRIC_AMOUNT), _row('Collections', _dollars('collections_dc')),
      _row('Charges', _dollars('charges_dc')), _row('Visits', _whole('visits_dc')))} FROM cw
  UNION ALL SELECT 8, list_concat(
      [concat('## SLIDE 8: {co} - CLIENT SUMMARY MONTH TO DATE (Day Range: ', MAX(day_range), ')'), '',
       {', '.join(map(_text, render.MONTH_HEAD))}],
      list(concat('| ', month_name, ' | ', {_dollars('collections')}, ' | ', {_dollars('charges')},
                  ' | ', {_whole('visits')}, ' |') ORDER BY months_back)) FROM md
  UNION ALL SELECT 9, list_concat(
      ['## SLIDE 9: {co} - UNBILLED STATUS', '',
       concat('| Visit Status | ', MAX(week), ' | Grand Total |'), '|--------------|------|-------------|'],
      list(CASE WHEN status = 'Total' THEN concat('| **Total** | **', visits, '** | **', visits, '** |')
           ELSE concat('| ', status, ' | ', visits, ' | ', visits, ' |') END ORDER BY position)) FROM ub
  UNION ALL SELECT 11, list_concat(
      ['## SLIDE 11: {co} - TOP 15 DENIAL CATEGORIES (All Time)', '',
       concat('| Denial Code | Description |', (SELECT string_agg(
          concat(' ', state, ' Count | ', state, ' Expected |'), '' ORDER BY state) FROM st)),
       concat('|-------------|-------------|', (SELECT repeat('------|------|', CAST(COUNT(*) AS INT)) FROM st))],
      (SELECT list(line ORDER BY total_visits DESC, code) FROM codes),
      [concat('| **Total** | |', (SELECT {denial_cells("**")}
          FROM st s LEFT JOIN stt c ON c.state = s.state)), '', '*Generated: {as_of} 00:00:00*']))
SELECT CAST(slide AS INT) AS slide, CAST(generate_subscripts(lines, 1) AS INT) AS line_no,
  unnest(lines) AS text FROM decks"""


def all_quarters_sql(quarterly: str, company: str, as_of: str) -> str:
    def across(label: str, value: str) -> str:
        return (f"concat('{label.ljust(render.LABEL_WIDTH)}', string_agg(concat({value}, "
                f"repeat(' ', greatest(0, {render.CELL} - length({value})))), '' ORDER BY quarter))")

    rows = ", ".join(across(render.KPI_ROWS[c][0], _FORMATS[render.KPI_ROWS[c][1]](c))
                     for c in R.QUARTER_COLUMNS if c in render.KPI_ROWS)
    type_row = across("Type", "concat('Q', quarter)")
    return f"""
WITH q AS ({quarterly}),
blocks AS (SELECT year, [concat('📅 ', year), '{render.MID_RULE}', '', {type_row},
    '{render.THIN_RULE}', {rows}, ''] AS lines FROM q GROUP BY year),
deck AS (SELECT list_concat(['╔{render.BOX_EDGE}╗', '║          {company.upper()} - QUARTERLY KPI REPORT (ALL)',
    '╚{render.BOX_EDGE}╝', ''], flatten(list(lines ORDER BY year)),
    ['{render.MID_RULE}', 'Generated: {as_of} 00:00:00']) AS lines FROM blocks)
SELECT CAST(generate_subscripts(lines, 1) AS INT) AS line_no, unnest(lines) AS text FROM deck"""


def answers_sql(oracle: Mapping[str, str]) -> str:
    def part(name: str, source: str, text: str) -> str:
        return f"SELECT '{name}' AS tool, {text} AS answer FROM ({oracle[source]})"

    def lines(*parts: str) -> str:
        return "concat(" + ", chr(10), ".join(parts) + ")"

    def labelled(label: str, value: str) -> str:
        return f"concat('- {label}: ', {value})"

    def bold(label: str, value: str) -> str:
        return f"concat('- **{label}: ', {value}, '**')"

    def share(c: str) -> str:
        return f"concat({_dollars(c)}, ' (', {_percent(c + '_pct')}, ')')"

    paid = labelled("Total Payments", _dollars("total_payments"))
    charged = labelled("Total Charges", _dollars("total_charges"))
    return " UNION ALL ".join([
        part("get_total_visits", "total_visits", f"concat('**Total Visits:** ', {_whole('row_visits')})"),
        part("get_total_charges", "total_charges", f"concat('**Total Charges:** ', {_dollars('charges')})"),
        part("get_gross_collection_rate", "tool_gross_collection_rate", lines(
            "'**Gross Collection Rate:**'", paid, charged, bold("GCR", _percent("gcr_pct")))),
        part("get_net_collection_rate", "tool_net_collection_rate", lines(
            "'**Net Collection Rate:**'", paid, labelled("Total Expected", _dollars("total_expected")),
            bold("NCR", _percent("ncr_pct")))),
        part("get_days_in_ar", "tool_days_in_ar", lines(
            "'**Days in AR:**'", labelled("Ending AR", _dollars("ending_ar")), charged,
            labelled("Period Days", "concat(period_days, ' (365 for full year, or YTD for current year)')"),
            bold("DAR", _days("days_in_ar")))),
        part("get_ar_summary", "ar_summary", lines(
            "'**AR Summary:**'", labelled("Total AR", _dollars("total_ar")), "'**AR Aging:**'",
            labelled("31-60 Days", _dollars("ar_31_60")), labelled("60-90 Days", _dollars("ar_60_90")),
            "'**Billed vs Unbilled AR:**'", labelled("Billed AR", share("billed_ar")),
            labelled("Unbilled AR", share("unbilled_ar"))))])
