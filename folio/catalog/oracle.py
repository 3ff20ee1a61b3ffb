"""For each query, the same result as SQL over the source tables."""

from __future__ import annotations

from folio.catalog.oracle_spine import with_views
from folio.functions.columns import BLIND_DROP_FIELDS, LEAKY_FIELDS
from folio.schemas import RECORD_COLUMNS, SPINE_DDL

CARD = "tenant_id, customer_id, customer_full_name, risk_score, risk_band, total_sales"
RISK = "risk_score desc nulls last, customer_id"


def top(order: str, where: str = "true", limit: str = "10", offset: str = "0", columns: str = CARD, source: str = "s_customers", by: str = "tenant_id") -> str:
    return (
        f'select {columns}, rn "rank" from (select *, row_number() over (partition by {by} order by {order}) rn '
        f"from {source} where {where}) x where rn > {offset} and rn <= {offset} + {limit}"
    )


def recent(columns: str, source: str, order: str, n: int) -> str:
    return top(order, limit=str(n), columns=f"tenant_id, customer_id, {columns}", source=source, by="tenant_id, customer_id")


def money(x: str) -> str:
    return (
        f"case when {x} is null then '—' when abs({x})>=1000000 then concat('$',case when {x}<0 then '-' else '' end,cast(cast(floor(abs({x})/100000+0.5) as bigint)//10 as varchar),'.',cast(cast(floor(abs({x})/100000+0.5) as bigint)%10 as varchar),'M')"
        f" when abs({x})>=1000 then concat('$',case when {x}<0 then '-' else '' end,cast(cast(floor(abs({x})/100+0.5) as bigint)//10 as varchar),'.',cast(cast(floor(abs({x})/100+0.5) as bigint)%10 as varchar),'k')"
        f" else concat('$',case when {x}<0 then '-' else '' end,cast(cast(floor(abs({x})+0.5) as bigint) as varchar)) end"
    )


def counts_for_all(name: str, source: str, where: str) -> str:
    return (
        f"select c.tenant_id, c.customer_id, coalesce(n,0) {name} from s_customers c left join "
        f"(select tenant_id, customer_id, count(*) n from {source} where {where} group by all) x using (tenant_id, customer_id)"
    )


TIMELINE = f"""
select tenant_id, customer_id, concat('o:',order_id) id, order_date "date", 'order' kind, concat('Order ',order_id) title,
  concat(coalesce(delivery_status,'—'),' · ',{money('order_sales')}) subtitle, cast(null as varchar) body,
  case when coalesce(late_delivery_risk=1,false) or contains(lower(coalesce(delivery_status,'')),'late') then 'Late' end badge,
  case when coalesce(late_delivery_risk=1,false) or contains(lower(coalesce(delivery_status,'')),'late') then 'warn' end tone
from s_orders where order_date is not null
union all select tenant_id, customer_id, concat('t:',ticket_id), date_of_purchase, 'ticket', coalesce(ticket_subject,ticket_type,'Support ticket'),
  concat(coalesce(ticket_priority,'?'),' · ',coalesce(ticket_status,'?'),' · ',coalesce(ticket_type,'')), ticket_description,
  case when ticket_priority='Critical' and coalesce(ticket_status,'')<>'Closed' then 'Critical · Open' when ticket_priority='Critical' then 'Critical' when coalesce(ticket_status,'')<>'Closed' then 'Open' end,
  case when ticket_priority='Critical' and coalesce(ticket_status,'')<>'Closed' then 'critical' when ticket_priority='Critical' then 'warn' else 'neutral' end
from s_tickets
union all select tenant_id, customer_id, concat('n:',note_id), note_date, 'note', coalesce(author,'Internal note'), concat(scenario,' · ',topic), note_text, null, null from s_notes
union all select tenant_id, customer_id, concat('e:',email_id), "date", 'email', coalesce(subject,'Email'),
  concat(lower(direction), case when sentiment_hint is not null then concat(' · ',sentiment_hint) else '' end), body, sentiment_hint,
  case sentiment_hint when 'Concerned' then 'warn' when 'Positive' then 'ok' end from s_emails
union all select tenant_id, customer_id, concat('f:',fulfillment_event_id), event_date, 'fulfillment', event_type,
  concat(severity,' · ',coalesce(root_cause,''),' · ',coalesce(resolution_status,'')), null, severity,
  case severity when 'High' then 'warn' when 'Critical' then 'critical' else 'neutral' end from s_fulfil
union all select tenant_id, customer_id, concat('g:',engagement_id), event_date, 'engagement', event_type, concat(coalesce(campaign,'—'),' · ',channel), null, null, null from s_engage
union all select tenant_id, customer_id, concat('r:',review_id), cast(reviewed_at as date), 'review', concat('Reviewed by ',coalesce(reviewer,'—')),
  concat('Decision: ',human_decision,' · ',scenario), review_notes, human_decision,
  case human_decision when 'Escalate' then 'critical' when 'Stabilize' then 'warn' else 'neutral' end from s_reviews"""

ALL_TABLES = {
    "customers": "s_customers", "customer_bridge": "s_people", "customer_contacts": "s_contacts", "customer_adjustments": "s_adjustments",
    "customer_email_logs": "s_emails", "customer_notes": "s_notes", "customer_review_logs": "s_reviews", "customer_support_bridge": "s_support_bridge",
    "engagement_events": "s_engage", "fulfillment_events": "s_fulfil", "order_lines": "s_order_lines", "orders": "s_orders",
    "review_outcomes": "s_outcomes", "support_tickets": "s_tickets",
}
KEYS = {
    "customers": "customer_id", "orders": "order_id", "order_lines": "order_line_id", "support_tickets": "ticket_id", "customer_notes": "note_id",
    "customer_email_logs": "email_id", "customer_review_logs": "review_id", "review_outcomes": "outcome_id", "engagement_events": "engagement_id",
    "fulfillment_events": "fulfillment_event_id", "customer_contacts": "contact_id", "customer_adjustments": "adjustment_id",
}
WIDTH = {
    "customers": 46, "customer_bridge": 7, "customer_contacts": 10, "customer_adjustments": 10, "customer_email_logs": 17, "customer_notes": 12,
    "customer_review_logs": 12, "customer_support_bridge": 10, "engagement_events": 9, "fulfillment_events": 9, "order_lines": 22, "orders": 25,
    "review_outcomes": 9, "support_tickets": 23,
}
DATES = [
    ("orders", "order_date", "s_orders", "order_date"), ("orders", "shipping_date", "s_orders", "shipping_date"),
    ("support_tickets", "date_of_purchase", "s_tickets", "date_of_purchase"), ("customer_notes", "note_date", "s_notes", "note_date"),
    ("customer_email_logs", "date", "s_emails", '"date"'), ("customer_review_logs", "reviewed_at", "s_reviews", "reviewed_at"),
    ("review_outcomes", "outcome_date", "s_outcomes", "outcome_date"), ("engagement_events", "event_date", "s_engage", "event_date"),
    ("fulfillment_events", "event_date", "s_fulfil", "event_date"), ("customer_adjustments", "created_date", "s_adjustments", "created_date"),
]
SYNTHETIC = {"customer_contacts": "avg(case when synthetic_flag then 1.0 else 0.0 end)"}
HAS_FLAG = ("customer_contacts", "customer_email_logs", "customer_notes", "customer_review_logs")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?[0-9]{1,2}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}"
TAGS = ("escalation_retention_case", "executive_escalation", "late_delivery_frustration", "late_delivery_recovery")

NET = "case when total>0 then cast(round_even((positive-negative)/total*100,0) as bigint) else 0 end net"
SHORT_SUMMARY = "tenant_id, total_customers, critical_count, high_count, moderate_count, low_count"

KPIS = f"""
select tenant_id, total_customers, critical_count+high_count at_risk, cast(floor((critical_count+high_count)/total_customers*100+0.5) as bigint) at_risk_pct,
  coalesce(followups,0)+coalesce(approvals,0) queue, coalesce(net,0) net_sentiment, total_revenue, revenue_at_risk, total_revenue/total_customers avg_deal,
  case when total_revenue>0 then total_profit/total_revenue*100 else 0 end margin_pct, greatest(0.0,total_revenue-total_profit) cost,
  avg_health_score avg_health, avg_late_delivery_rate*100 late_pct, churn_flag_count/total_customers*100 churn_pct,
  open_ticket_backlog/total_customers backlog_per_customer, case when total_revenue>0 then revenue_top10/total_revenue*100 else 0 end concentration_pct,
  critical_count/total_customers*100 critical_pct, high_count/total_customers*100 high_pct, moderate_count/total_customers*100 moderate_pct, low_count/total_customers*100 low_pct,
  case when total>0 then positive/total*100 else 0 end positive_pct, case when total>0 then neutral/total*100 else 0 end neutral_pct,
  case when total>0 then negative/total*100 else 0 end negative_pct
from s_summary left join (select *, {NET} from (select tenant_id, sum(positive)::bigint positive, sum(neutral)::bigint neutral, sum(negative)::bigint negative, sum(total)::bigint total
    from s_moods group by all) y) m using (tenant_id)
left join (select tenant_id, count(*) followups from s_followups where "rank"<=10 group by all) f using (tenant_id)
left join (select tenant_id, least(20,count(*)) approvals from s_state where status='pending' group by all) a using (tenant_id)"""
KPI_FLOATS = (
    "total_revenue", "revenue_at_risk", "avg_deal", "margin_pct", "cost", "avg_health", "late_pct", "churn_pct", "backlog_per_customer", "concentration_pct",
    "critical_pct", "high_pct", "moderate_pct", "low_pct", "positive_pct", "neutral_pct", "negative_pct",
)
TONES = (
    ("margin_pct", "margin_pct", ">=20", ">=10"), ("avg_health", "avg_health", ">=70", ">=40"), ("late_pct", "late_pct", "<=10", "<=25"),
    ("concentration_pct", "concentration_pct", "<40", "<60"), ("churn_pct", "churn_pct", "<=5", "<=15"),
    ("backlog_pct", "backlog_per_customer*100", "<=20", "<=50"), ("at_risk_pct", "at_risk_pct", "<20", "<20"), ("net_sentiment", "net_sentiment", ">=25", ">-25"),
)

STATE = "tenant_id, action_id, customer_id, customer_full_name, action_type, payload_json, status, created_at, decided_at, decided_by, rationale, confidence, sent_at, send_error"

KAPPA = """
select hits, shared, round(case when shared=0 then null when expected=1 then case when hits=shared then 1.0 else 0.0 end
  else (hits/shared-expected)/(1-expected) end, 6) kappa"""
AGREE = """cast(coalesce(sum(n) filter (a=b),0) as bigint) hits, cast(coalesce(sum(n),0) as bigint) shared,
  (coalesce(sum(n) filter (a='Monitor'),0)::double*coalesce(sum(n) filter (b='Monitor'),0)+coalesce(sum(n) filter (a='Stabilize'),0)::double*coalesce(sum(n) filter (b='Stabilize'),0)
  +coalesce(sum(n) filter (a='Escalate'),0)::double*coalesce(sum(n) filter (b='Escalate'),0))/(sum(n)::double*sum(n)) expected"""
WILSON = """
select hits, shared, round(case when shared=0 then 0.0 else greatest(0.0,(p+1.96*1.96/(2*shared)-1.96*sqrt(p*(1-p)/shared+1.96*1.96/(4.0*shared*shared)))/(1+1.96*1.96/shared)) end,6) low,
  round(case when shared=0 then 0.0 else least(1.0,(p+1.96*1.96/(2*shared)+1.96*sqrt(p*(1-p)/shared+1.96*1.96/(4.0*shared*shared)))/(1+1.96*1.96/shared)) end,6) high
from (select hits, shared, hits/shared p from (select cast(coalesce(sum(n) filter (a=b),0) as bigint) hits, cast(coalesce(sum(n),0) as bigint) shared from s_pairs) y) x"""


def volume_sample(source: str, key: str, low: int, high: int) -> str:
    third = (high - low) // 3
    top_low, mid_low, mid_high, low_high = int(0.7 * high), low + third, low + 2 * (high - low) // 3, low + max(1, third)
    return f"""
select x.tenant_id, x.customer_id, {key} from (select *, row_number() over (partition by tenant_id, customer_id order by md5(concat('42:',{key})), {key}) rn,
  cast(concat('0x',substr(md5(concat('42:volume:',customer_id)),1,8)) as bigint) h from {source}) x join s_customers c using (tenant_id, customer_id)
where rn <= case when risk_band ilike '%critical%' or risk_band ilike '%high%' then {top_low}+h%{high - top_low + 1}
  when risk_band ilike '%elevated%' or risk_band ilike '%moderate%' then {mid_low}+h%{mid_high - mid_low + 1} else {low}+h%{low_high - low + 1} end"""


def redacted(text: str, name: str) -> str:
    hidden = f"regexp_replace({text}, '{'|'.join(TAGS)}', '[redacted]', 'gi')"
    return f"regexp_replace({hidden}, {name}, 'the customer', 'gi')"


def lineage(keep: bool) -> str:
    own = "case when trim(coalesce(source_signal_ids,''))<>'' then source_signal_ids else coalesce(refs,'') end" if keep else "coalesce(refs,'')"
    return (
        f"select e.tenant_id, email_id, {own} source_signal_ids, coalesce(n,0) ref_count from s_emails e left join s_lineage l "
        "on l.tenant_id=e.tenant_id and l.customer_id=e.customer_id and l.scenario=e.scenario and l.topic=e.topic"
    )


def _names() -> str:
    return f"""
select r.tenant_id, request, outcome, case when outcome<>'not_found' then rn end "rank", r.customer_id, customer_full_name, risk_band, customer_country
from (select *, row_number() over (partition by tenant_id, request order by place) rn from (
  select tenant_id, request, 'exact' outcome, 0 place, exact_id customer_id from n_asked join n_exact using (tenant_id, needle)
  union all select a.tenant_id, request, 'exact', rn, customer_id from n_asked a join n_exact e using (tenant_id, needle) join n_near n using (tenant_id, needle)
    where rn<=6 and lower(n.customer_full_name)=needle and customer_id<>exact_id
  union all select a.tenant_id, request, case when several then 'ambiguous' else 'match' end, rn, customer_id from n_asked a join n_near n using (tenant_id, needle)
    join (select tenant_id, needle, count(*)>1 several from n_near group by all) s using (tenant_id, needle)
    where rn<=5 and not exists (from n_exact e where e.tenant_id=a.tenant_id and e.needle=a.needle)
  union all select a.tenant_id, request, case when n.customer_id is null then 'not_found' else 'suggestion' end, coalesce(rn,0), n.customer_id
    from n_asked a left join (select * from n_near where rn<=5) n on n.tenant_id=a.tenant_id and n.needle=a.last_word
    where not exists (from n_near e where e.tenant_id=a.tenant_id and e.needle=a.needle) and not exists (from n_exact e where e.tenant_id=a.tenant_id and e.needle=a.needle)
  ) y) r left join s_customers c on c.tenant_id=r.tenant_id and c.customer_id=r.customer_id"""


NAME_VIEWS = """
n_requests as (select distinct tenant_id, unnest([lower(customer_full_name), concat(' ',customer_full_name), split_part(customer_full_name,' ',2),
    concat('Zed ',split_part(customer_full_name,' ',2)), concat(split_part(customer_full_name,' ',1),' ',substr(split_part(customer_full_name,' ',2),1,2)),
    split_part(customer_email,'@',1), concat('Nobody Quix',substr(split_part(customer_full_name,' ',2),1,1)), '', 'xyzzy']) request from s_customers),
n_asked as (select tenant_id, request, lower(trim(request)) needle, case when contains(trim(request),' ') then split_part(lower(trim(request)),' ',-1) end last_word from n_requests),
n_needles as (select tenant_id, needle from n_asked where needle<>'' union select tenant_id, last_word from n_asked where last_word is not null),
n_exact as (select n.tenant_id, needle, customer_id exact_id from n_needles n join s_customers c on c.tenant_id=n.tenant_id and lower(customer_full_name)=needle
  qualify row_number() over (partition by n.tenant_id, needle order by risk_score desc nulls last, customer_id)=1),
n_near as (select n.tenant_id, needle, customer_id, customer_full_name, row_number() over (partition by n.tenant_id, needle order by risk_score desc nulls last, customer_id) rn
  from n_needles n join s_customers c on c.tenant_id=n.tenant_id and (contains(lower(customer_full_name),needle) or contains(lower(customer_email),needle)) qualify rn<=8)"""


def _long(source: str, block: str, klass: str, **metrics: str) -> str:
    return " union all ".join(
        f"""select '{block}' block, '{m}' metric, {klass} "class", round(cast({v} as double),6) "value" from ({source}) z""" for m, v in metrics.items()
    )


def _label_report() -> str:
    """The report for labelers a and c, with b as the model."""
    pairs = "select a.labeler la, b.labeler lb, a.decision a, b.decision b, count(*) n from s_votes a join s_votes b on a.tenant_id=b.tenant_id and a.case_id=b.case_id where a.labeler in ('a','c') group by all"
    synthetic = f"{KAPPA}, la, labeled from (select la, {AGREE} from (select v.labeler la, v.decision a, r.human_decision b, count(*) n from s_votes v join s_reviews r on r.tenant_id=v.tenant_id and r.review_id=v.case_id where v.labeler<>'b' group by all) y group by la) x join (select labeler, count(*) labeled from s_votes group by all) t on labeler=la"
    both = f"{KAPPA}, la, lb from (select la, lb, {AGREE} from ({pairs}) y where la<lb and lb<>'b' and la<>'b' group by la, lb) x"
    majority = "select tenant_id, case_id, decision from (select tenant_id, case_id, decision, count(*) v, max(count(*)) over (partition by tenant_id, case_id) m from s_votes where labeler<>'b' group by tenant_id, case_id, decision) x where v=m qualify count(*) over (partition by tenant_id, case_id)=1"
    decided = f"select count(*) n, count(*) filter (decision='Monitor') mo, count(*) filter (decision='Stabilize') st, count(*) filter (decision='Escalate') es from ({majority}) x"
    agree = {"hits": "hits", "shared": "shared", "kappa": "kappa"}
    parts = [
        _long(synthetic, "labeler_vs_synthetic", "la", labeled="labeled", **agree),
        _long(both, "labeler_pair", "concat(la,'/',lb)", **agree),
        _long(decided, "reference", "null", cases_with_majority="n", Monitor="mo", Stabilize="st", Escalate="es"),
    ]
    truths = {"model_vs_reference": majority, "model_vs_synthetic": "select tenant_id, review_id case_id, human_decision decision from s_reviews"}
    for block, truth in truths.items():
        cells = f"select t.decision a, v.decision b, count(*) n from ({truth}) t join s_votes v on v.tenant_id=t.tenant_id and v.case_id=t.case_id and v.labeler='b' group by all"
        summary = f"{KAPPA}, hits/shared p from (select {AGREE} from ({cells}) y) x"
        z = "1.96*1.96"
        half = f"1.96*sqrt(p*(1-p)/shared+{z}/(4.0*shared*shared))"
        parts.append(_long(
            summary, block, "null", accuracy="p", low=f"greatest(0.0,(p+{z}/(2*shared)-{half})/(1+{z}/shared))", high=f"least(1.0,(p+{z}/(2*shared)+{half})/(1+{z}/shared))", **agree))
        prf = f"""select d k, coalesce(sum(n) filter (a=d),0) support, coalesce(sum(n) filter (a=d and b=d),0) tp, coalesce(sum(n) filter (b=d),0) called
          from (values ('Monitor'),('Stabilize'),('Escalate')) c(d) left join ({cells}) y on a=d or b=d group by d"""
        f1 = "case when tp>0 then 2.0*(tp/called)*(tp/support)/((tp/called)+(tp/support)) else 0.0 end"
        parts.append(_long(f"select avg({f1}) m from ({prf}) w where support>0", block, "null", macro_f1="m"))
        parts.append(_long(prf, block, "k", support="support", precision="case when called>0 then tp/called else 0 end", recall="case when support>0 then tp/support else 0 end", f1=f1))
        grid = f"""select concat(x,'/',w) k, coalesce(n,0) n from (values ('Monitor'),('Stabilize'),('Escalate')) c(x), (values ('Monitor'),('Stabilize'),('Escalate')) d(w)
          left join ({cells}) y on a=x and b=w"""
        parts.append(_long(grid, block, "k", confusion="n"))
    return " union all ".join(parts)


def fields(table: str) -> list[tuple[str, str]]:
    """Name and type of the declared columns, without a session."""
    return [tuple(x.split()) for x in SPINE_DDL[table].split(",")]


def whole(table: str) -> str:
    """A table with all its declared columns; those that the source does not fill are null."""
    kinds = {"string": "varchar", "timestamp_ntz": "timestamp"}
    empty = ", ".join(f"cast(null as {kinds.get(kind, kind)}) {name}" for name, kind in fields(table))
    return f"(select {empty} where false union all by name select * from {ALL_TABLES[table]})"


def text_columns(table: str, columns: tuple[str, ...] = ()) -> list[str]:
    """The declared text columns, or those of them that are asked for."""
    texts = ["tenant_id", *(name for name, kind in fields(table) if kind == "string")]
    return [c for c in columns or texts if c in texts]


def _columns() -> str:
    parts = []
    for t in ALL_TABLES:
        names = ["tenant_id", *(name for name, _ in fields(t))]
        entries = ", ".join(f"{{'position': {i}, 'column_name': '{c}', 'filled_rows': count({c})}}" for i, c in enumerate(names, start=1))
        parts.append(f"select '{t}' table_name, x.position \"position\", x.column_name, x.filled_rows from (select unnest([{entries}]) x from {whole(t)} w) c")
    return " union all ".join(parts)


def _patterns() -> str:
    parts = []
    for t in ALL_TABLES:
        entries = ", ".join(
            f"{{'c': '{c}', 'e': count(*) filter (regexp_matches({c},'{EMAIL}')), 'p': count(*) filter (regexp_matches({c},'{PHONE}'))}}" for c in text_columns(t))
        parts.append(f"select '{t}' table_name, x.c column_name, x.e email_cells, x.p phone_cells from (select unnest([{entries}]) x from {whole(t)} w) c")
    return " union all ".join(parts)


# The feeds of a bundle: table, name in s_recent5, key.
FEEDS = (
    ("orders", "orders", "order_id"), ("support_tickets", "tickets", "ticket_id"), ("customer_notes", "notes", "note_id"),
    ("customer_email_logs", "emails", "email_id"), ("fulfillment_events", "fulfil", "fulfillment_event_id"),
)


def _redacted_cells() -> str:
    parts = []
    for t, _, key in FEEDS:
        texts = [c for c in text_columns(t, RECORD_COLUMNS[t]) if c not in BLIND_DROP_FIELDS]
        cells = ", ".join(f"{{'column_name': '{c}', 'text': {redacted('w.' + c, 'c.customer_full_name')}}}" for c in texts)
        parts.append(
            f"select '{t}' table_name, tenant_id, record_id, x.column_name, x.text \"text\" from (select w.tenant_id, w.{key} record_id, unnest([{cells}]) x "
            f"from {whole(t)} w join s_customers c on c.tenant_id=w.tenant_id and c.customer_id=w.customer_id) f")
    return " union all ".join(parts)


def _case_texts() -> str:
    """The sampled cases with the sizes and every blind text of their feeds."""
    fields = {"orders": "recent_orders", "tickets": "recent_tickets", "notes": "recent_notes", "emails": "recent_emails", "fulfil": "fulfillment_events"}
    joins, columns = [], []
    for t, feed, key in FEEDS:
        texts = [redacted(f"w.{c}", "c.customer_full_name") for c in text_columns(t, RECORD_COLUMNS[t]) if c not in BLIND_DROP_FIELDS]
        joins.append(
            f"left join (select r.tenant_id, r.customer_id, count(*) n, string_agg(concat_ws('|', {', '.join(texts)}), '||' order by rn) x from s_recent5 r "
            f"join {whole(t)} w on w.tenant_id=r.tenant_id and w.{key}=r.id join s_customers c on c.tenant_id=r.tenant_id and c.customer_id=r.customer_id "
            f"where feed='{feed}' and rn<=5 group by all) f_{feed} on f_{feed}.tenant_id=s.tenant_id and f_{feed}.customer_id=s.customer_id")
        columns.append(f"coalesce(f_{feed}.n,0) {fields[feed]}, coalesce(f_{feed}.x,'') {fields[feed]}_texts")
    return (
        f"select s.tenant_id, concat('H',lpad(cast(\"position\" as varchar),3,'0')) case_id, review_id, s.customer_id, reviewed_at review_date, {', '.join(columns)} "
        f"from s_sample20 s {' '.join(joins)}")


def _leaks() -> str:
    """Accounts whose bundle shows a tag in any text, or a decision or notes of a prior review; and the same after redaction."""
    own = [c for c in text_columns("customers", RECORD_COLUMNS["customers"]) if c not in LEAKY_FIELDS]
    reviews = "(select *, row_number() over (partition by tenant_id, customer_id order by reviewed_at desc nulls last, review_id) rn from s_reviews)"

    def cells(blind: bool) -> str:
        def listed(columns: list[str], prefix: str) -> str:
            return ", ".join(redacted(prefix + c, "c.customer_full_name") if blind else prefix + c for c in columns if not blind or c not in BLIND_DROP_FIELDS)

        parts = [f"select c.tenant_id, c.customer_id, unnest([{listed(own, 'c.')}]) txt from {whole('customers')} c"]
        if not blind:
            parts.append(f"select tenant_id, customer_id, unnest([scenario, topic, human_decision, review_notes]) from {reviews} r where rn<=5")
        for t, feed, key in FEEDS:
            parts.append(
                f"select c.tenant_id, c.customer_id, unnest([{listed(text_columns(t, RECORD_COLUMNS[t]), 'w.')}]) from s_recent5 r "
                f"join {whole(t)} w on r.feed='{feed}' and r.rn<=5 and w.tenant_id=r.tenant_id and w.{key}=r.id "
                "join s_customers c on c.tenant_id=r.tenant_id and c.customer_id=r.customer_id")
        return " union all ".join(parts)

    tags = ", ".join(f"('{t}')" for t in TAGS)
    stages = [
        f"select '{stage}' stage, tag leak, tenant_id, customer_id from ({cells(blind)}) x join (values {tags}) v(tag) on contains(lower(txt), tag)"
        for stage, blind in (("raw", False), ("redacted", True))
    ]
    stages.append(f"select 'raw', 'prior review decision or notes', tenant_id, customer_id from {reviews} r where rn<=5 and (human_decision is not null or review_notes is not null)")
    return f"select stage, leak, count(distinct (tenant_id, customer_id)) \"rows\" from ({' union all '.join(stages)}) y group by all"


def _tone_rows() -> str:
    return " union all ".join(
        f"""select tenant_id, '{m}' metric, round(cast({v} as double),4) "value", case when {v}{good} then 'good' when {v}{okay} then 'okay' else 'warn' end tone from ({KPIS}) k"""
        for m, v, good, okay in TONES
    )


def _repair_log() -> str:
    def line(step: str, metric: str, sql: str) -> str:
        return f"select tenant_id, '{step}' step, '{metric}' metric, cast(v as bigint) \"value\" from ({sql}) z"

    pending = "cast(concat('0x',substr(md5(concat('42:pending:',outcome_id)),1,8)) as bigint)%100<20"
    emails = volume_sample(f"({lineage(False)}) join (select tenant_id, email_id, customer_id from s_emails) using (tenant_id, email_id)", "email_id", 2, 20).replace(
        "select x.tenant_id, x.customer_id, email_id", "select x.tenant_id, x.source_signal_ids")
    notes = volume_sample("s_notes", "note_id", 1, 12)
    parts = [
        line("dates", "orders_shift_days", "select tenant_id, date '2026-04-09'-max(order_date) v from s_orders group by all"),
        line("dates", "tickets_shift_days", "select tenant_id, date '2026-05-02'-max(date_of_purchase) v from s_tickets group by all"),
        line("outcomes", "pending", f"select tenant_id, count(*) filter ({pending} or outcome_status='Pending') v from s_outcomes group by all"),
        line("outcomes", "dated", f"select tenant_id, count(*) filter (not ({pending})) v from s_outcomes group by all"),
        line("lineage", "emails_with_refs_before", "select tenant_id, count(*) filter (trim(coalesce(source_signal_ids,''))<>'') v from s_emails group by all"),
        line("lineage", "emails_with_refs", f"select tenant_id, count(*) filter (trim(source_signal_ids)<>'') v from ({lineage(False)}) e group by all"),
        line("lineage", "emails", f"select tenant_id, count(*) v from ({lineage(False)}) e group by all"),
        line("tickets", "accounts_without_tickets", "select c.tenant_id, count(*) filter (s.customer_id is null) v from s_customers c left join (select distinct tenant_id, customer_id from s_spread) s using (tenant_id, customer_id) group by all"),
        "select tenant_id, 'tickets' step, concat('accounts_with_',n,'_tickets') metric, count(*) \"value\" from (select tenant_id, customer_id, count(*) n from s_spread group by all) z group by all",
        line("customer_notes", "rows_before", "select tenant_id, count(*) v from s_notes group by all"),
        line("customer_notes", "rows_after", f"select tenant_id, count(*) v from ({notes}) e group by all"),
        line("customer_email_logs", "rows_before", "select tenant_id, count(*) v from s_emails group by all"),
        line("customer_email_logs", "rows_after", f"select tenant_id, count(*) v from ({emails}) e group by all"),
        line("support_tickets", "rows_before", "select tenant_id, count(*) v from s_tickets group by all"),
        line("support_tickets", "rows_after", "select tenant_id, count(*) v from s_spread group by all"),
    ]
    return " union all ".join(parts)


def statements() -> dict[str, str]:
    children = [t for t in ALL_TABLES if t != "customers"]
    named = " union all ".join(f"select '{t}' table_name, tenant_id, customer_id from {ALL_TABLES[t]}" for t in children)
    keyed = " union all ".join(f"select '{t}' table_name, '{k}' key_column, tenant_id, {k} key from {ALL_TABLES[t]}" for t, k in KEYS.items())
    texts = {"customer_notes": "length(note_text)", "customer_email_logs": "length(body)"}
    state_rank = "row_number() over (partition by tenant_id order by created_at desc, action_id)"
    sql = {
        "load_spine": " union all ".join(
            f"select '{t}' table_name, count(*) \"rows\", cast({'sum(' + texts[t] + ')' if t in texts else 'count(*)'} as bigint) content, 'demo' tenant_id from {v}" for t, v in ALL_TABLES.items()),
        "table_counts": " union all ".join(f"select '{t}' table_name, count(*) \"rows\" from {v}" for t, v in ALL_TABLES.items()),
        "account_by_id": f"select {CARD} from s_customers where customer_id in ('C7','C100','C1200','nobody')",
        "account_by_name": f"select {CARD} from s_customers where lower(customer_full_name)='mary smith' qualify row_number() over (partition by tenant_id order by {RISK})=1",
        "search_accounts": top(RISK, "contains(lower(customer_full_name),'smith') or contains(lower(customer_email),'smith')"),
        "search_prefix": top(RISK, "starts_with(lower(customer_full_name),'ma')", "20"),
        "by_band": top(RISK, "risk_band ilike '%high%'", "50"),
        "resolve_ids": """
select q.tenant_id, request_id, pos, c.customer_id, customer_full_name "name", customer_email email, risk_score
from (select tenant_id, session_id request_id, unnest([customer_id, 'C1', 'nobody', customer_id]) id, unnest([0,1,3,4]) pos from s_sessions) q
join s_customers c on c.tenant_id=q.tenant_id and c.customer_id=q.id""",
        "slim_profile": """
select tenant_id, customer_id, customer_full_name "name", customer_email email, customer_segment segment, customer_country country, total_orders, total_sales, total_profit,
  late_delivery_rate, support_ticket_count, open_support_ticket_count open_tickets, risk_score, risk_band, health_score, lifecycle_stage, churn_risk_reason,
  next_best_action, cast(null as varchar) last_review_decision from s_customers""",
        "resolve_names": _names(),
        "pending_outcomes": top("outcome_id", "outcome_status='Pending'", "50", columns="tenant_id, outcome_id, review_id, follow_up_required", source="s_outcomes"),
        "outcome_for_review": "select tenant_id, review_id, outcome_id, outcome_status from s_outcomes where review_id in ('R4','R36','R7')",
        "action_type_facet": "select distinct tenant_id, action_type from s_state",
        "actions_of_type": "select tenant_id, action_id, customer_id, status from s_state where action_type='send_email'",
        "page_accounts": top(RISK, limit="25", offset="50"),
        "page_accounts_deep": top(RISK, limit="2000", offset="100"),
        "top_at_risk": top(RISK),
        "top_at_risk_band": top(RISK, "risk_band ilike '%elevated%'"),
        "top_healthy": top("risk_score nulls last, total_sales desc nulls last, customer_id", "coalesce(total_sales,0)>0", "60"),
        "top_by_revenue": top("total_sales desc nulls last, customer_id"),
        "top_by_revenue_lowest": top("total_sales nulls last, customer_id"),
        "directory": top("coalesce(late_delivery_rate,0) desc, customer_id", "risk_band ilike '%e%'", "50", "50", CARD + ", late_delivery_rate"),
        "directory_by_risk": top("coalesce(risk_score,0) desc, customer_id", limit="50"),
        "directory_by_revenue": top("coalesce(total_sales,0) desc, customer_id", limit="50"),
        "directory_by_name": top("lower(customer_full_name), customer_id", limit="50"),
        "recent_orders": recent("order_id, order_date, delivery_status, order_sales", "s_orders", "order_date desc nulls last, order_id", 10),
        "recent_tickets": recent("ticket_id, date_of_purchase, ticket_status", "s_tickets", "date_of_purchase desc nulls last, ticket_id", 10),
        "recent_notes": recent("note_id, note_date, note_text", "s_notes", "note_date desc nulls last, note_id", 10),
        "recent_emails": recent('email_id, "date", message_sequence', "s_emails", '"date" desc nulls last, message_sequence desc nulls last, email_id', 10),
        "recent_reviews": recent("review_id, reviewed_at, human_decision", "s_reviews", "reviewed_at desc nulls last, review_id", 10),
        "recent_engagement": recent("engagement_id, event_date, engagement_score", "s_engage", "event_date desc nulls last, engagement_id", 20),
        "recent_fulfillment": recent("fulfillment_event_id, event_date, severity", "s_fulfil", "event_date desc nulls last, fulfillment_event_id", 20),
        "email_thread": "select tenant_id, thread_id, message_sequence, email_id, body from s_emails order by 1,2,3,4",
        "recent_history": top("created_at desc, message_id desc", limit="20", columns="session_id, message_id, role, content", source="s_messages", by="session_id"),
        "session_messages": "select tenant_id, session_id, message_id, role, content, created_at from s_messages join s_sessions using (session_id)",
        "session_activity": "select tenant_id, session_id, least(min(created_at),any_value(started_at)) first_seen, greatest(max(created_at),any_value(started_at)) last_active, count(message_id) messages from s_sessions left join s_messages using (session_id) group by all",
        "late_counts": counts_for_all("late_orders", "s_orders", "late_delivery_risk=1"),
        "open_ticket_counts": counts_for_all("open_tickets", "s_tickets", "ticket_status not ilike '%closed%'"),
        "unresolved_counts": counts_for_all("unresolved", "s_fulfil", "resolution_status not ilike '%resolved%' and resolution_status not ilike '%closed%'"),
        "recent_activity": """
select c.tenant_id, c.customer_id, customer_full_name, e.d last_email_at, n.d last_note_at, o.d last_order_at, cast(r.d as date) last_review_at, g.d last_engagement_at from s_customers c
left join (select tenant_id, customer_id, max("date") d from s_emails group by all) e using (tenant_id, customer_id)
left join (select tenant_id, customer_id, max(note_date) d from s_notes group by all) n using (tenant_id, customer_id)
left join (select tenant_id, customer_id, max(order_date) d from s_orders group by all) o using (tenant_id, customer_id)
left join (select tenant_id, customer_id, max(reviewed_at) d from s_reviews group by all) r using (tenant_id, customer_id)
left join (select tenant_id, customer_id, max(event_date) d from s_engage group by all) g using (tenant_id, customer_id)""",
        "activity_counts": "select tenant_id, customer_id, " + ", ".join(f"coalesce({t}_n,0) {t}" for t in (
            "customer_email_logs", "customer_notes", "customer_review_logs", "engagement_events", "fulfillment_events", "orders", "support_tickets"))
        + " from s_customers " + " ".join(
            f"left join (select tenant_id, customer_id, count(*) {t}_n from {ALL_TABLES[t]} group by all) x_{t} using (tenant_id, customer_id)" for t in (
                "customer_email_logs", "customer_notes", "customer_review_logs", "engagement_events", "fulfillment_events", "orders", "support_tickets")),
        "timeline": TIMELINE,
        "timeline_panel": " union all ".join(
            f"select tenant_id, customer_id, concat('{p}:',{k}) id, cast({d} as date) \"date\", '{kind}' kind from (select *, row_number() over (partition by tenant_id, customer_id order by {d} desc nulls last, {extra}{k}) rn from {v}) x where rn<={n}"
            for p, k, d, kind, v, n, extra in (
                ("o", "order_id", "order_date", "order", "s_orders", 10, ""), ("t", "ticket_id", "date_of_purchase", "ticket", "s_tickets", 10, ""),
                ("n", "note_id", "note_date", "note", "s_notes", 10, ""), ("e", "email_id", '"date"', "email", "s_emails", 10, "message_sequence desc, "),
                ("f", "fulfillment_event_id", "event_date", "fulfillment", "s_fulfil", 20, ""), ("g", "engagement_id", "event_date", "engagement", "s_engage", 20, ""),
                ("r", "review_id", "reviewed_at", "review", "s_reviews", 10, ""))),
        "recency": """
select tenant_id, customer_id, order_id, order_date, case when d<0 then concat('in ',-d,'d') when d=0 then 'today' when d=1 then 'yesterday' when d<30 then concat(d,'d ago')
  when d<365 then concat(cast(floor(d/30.0+0.5) as bigint),'mo ago') else concat(cast(floor(d/365.0+0.5) as bigint),'y ago') end label
from (select *, date '1998-08-02'-order_date d from s_orders) x""",
        "portfolio_summary": f"""
select {SHORT_SUMMARY}, churn_flag_count, open_ticket_backlog, other_count, round(avg_risk_score,6) avg_risk_score, round(avg_health_score,6) avg_health_score,
  round(avg_late_delivery_rate,6) avg_late_delivery_rate, round(total_revenue,2) total_revenue, round(revenue_at_risk,2) revenue_at_risk, round(revenue_top10,2) revenue_top10,
  round(total_profit,4) total_profit from s_summary""",
        "v_portfolio_summary": f"select {SHORT_SUMMARY}, round(avg_risk_score,6) avg_risk_score, round(avg_health_score,6) avg_health_score, round(total_revenue,2) total_revenue, round(total_profit,4) total_profit from s_summary",
        "top_decile_revenue": "select tenant_id, round(revenue_top10,2) revenue_top10 from s_summary",
        "sentiment_signals_classified": "select signal, bucket, count(*) signals from s_signals group by all",
        "sentiment_signals_strict": "select signal, strict_bucket bucket, count(*) signals from s_signals group by all",
        "portfolio_sentiment": f"select *, {NET} from (select tenant_id, sum(positive)::bigint positive, sum(neutral)::bigint neutral, sum(negative)::bigint negative, sum(total)::bigint total from s_moods group by all) x",
        "customer_sentiment": f"select *, {NET} from (select c.tenant_id, c.customer_id, coalesce(positive,0) positive, coalesce(neutral,0) neutral, coalesce(negative,0) negative, coalesce(total,0) total from s_customers c left join s_moods using (tenant_id, customer_id)) x",
        "band_distribution": "select tenant_id, case when risk_band ilike '%critical%' then 'critical' when risk_band ilike '%high%' then 'high' when risk_band ilike '%moderate%' or risk_band ilike '%elevated%' then 'moderate' when risk_band ilike '%low%' then 'low' else 'stable' end bucket, count(*) accounts from s_customers group by all",
        "lane_counts": "select tenant_id, lane, count(*) accounts from (select *, case when open_support_ticket_count>0 then 'open_tickets' when late_delivery_rate>0.5 then 'late_deliveries' when health_score<30 then 'health_concerns' else 'watch_list' end lane from s_customers) x group by all",
        "lanes": top(RISK, limit="3", columns=CARD + ", lane", by="tenant_id, lane", source="(select *, case when open_support_ticket_count>0 then 'open_tickets' when late_delivery_rate>0.5 then 'late_deliveries' when health_score<30 then 'health_concerns' else 'watch_list' end lane from s_customers) l"),
        "account_cards": f"""
select {CARD}, "rank", lane, positive, neutral, negative, total, {NET} from (select c.*, row_number() over (partition by tenant_id order by {RISK}) "rank",
  case when open_support_ticket_count>0 then 'open_tickets' when late_delivery_rate>0.5 then 'late_deliveries' when health_score<30 then 'health_concerns' else 'watch_list' end lane,
  coalesce(positive,0) positive, coalesce(neutral,0) neutral, coalesce(negative,0) negative, coalesce(total,0) total
  from s_customers c left join s_moods using (tenant_id, customer_id)) x where "rank"<=60""",
        "pending_followups": 'select tenant_id, customer_id, review_id, reviewed_at, human_decision, outcome_status, follow_up_required, outcome_date, risk_band, risk_score, next_best_action, "rank" from s_followups where "rank"<=12',
        "portfolio_kpis": f"select tenant_id, total_customers, at_risk, at_risk_pct, queue, net_sentiment, {', '.join(f'round({c},4) {c}' for c in KPI_FLOATS)} from ({KPIS}) k",
        "kpi_tones": _tone_rows(),
        "audit_inventory": " union all ".join(
            f"select '{t}' table_name, count(*) \"rows\", {WIDTH[t]} \"columns\", round({SYNTHETIC.get(t, '0.0' if t in HAS_FLAG else 'null')}::double,6) synthetic_share from {v}" for t, v in ALL_TABLES.items()),
        "fk_coverage": f"""
select table_name, count(*) named_ids, count(*) filter (c.customer_id is null) unknown_ids, count(*) filter (c.customer_id is not null) covered,
  round(count(*) filter (c.customer_id is not null)/(select count(*) from s_customers),6) coverage
from (select distinct * from ({named}) a) x left join s_customers c on c.tenant_id=x.tenant_id and c.customer_id=x.customer_id group by table_name""",
        "audit_dates": " union all ".join(
            f"select '{t}' table_name, '{name}' column_name, cast(min({c}) as date) first_day, cast(max({c}) as date) last_day, count(*) filter ({c}>timestamp '1998-01-01') future_rows, count(*) filter ({c} is null) null_rows from {v}" for t, name, v, c in DATES),
        "audit_duplicates": f"select table_name, key_column, cast(sum(n-1) as bigint) duplicates from (select table_name, key_column, tenant_id, key, count(*) n from ({keyed}) a group by all) x group by all",
        "value_counts": " union all ".join(
            f"select * from (select '{t}' table_name, scenario \"value\", count(*) \"rows\" from {v} group by all order by 3 desc, 2 limit 10) {v}"
            for t, v in (("customer_notes", "s_notes"), ("customer_email_logs", "s_emails"), ("customer_review_logs", "s_reviews"))),
        "ref_resolution": """
select r.table_name, r."rows", rows_with_refs, coalesce(refs,0) refs, coalesce(resolved,0) resolved, round(coalesce(resolved,0)/greatest(coalesce(refs,0),1),6) resolved_share
from (select table_name, count(*) "rows", count(*) filter (trim(coalesce(s,''))<>'') rows_with_refs from cited group by all) r
left join (select table_name, count(*) refs, count(*) filter (k.id is not null) resolved from (select table_name, tenant_id, unnest(string_split(replace(s,' ',''),';')) ref from cited) c
  left join known k on k.tenant_id=c.tenant_id and k.id=c.ref where ref<>'' group by all) x using (table_name)""",
        "audit_pii_patterns": _patterns(),
        "audit_columns": _columns(),
        "audit_sample": """
select tenant_id, customer_id, customer_full_name, customer_segment, total_sales, late_delivery_rate,
  (select count(*) from s_emails e where e.customer_id=c.customer_id) customer_email_logs, (select count(*) from s_notes n where n.customer_id=c.customer_id) customer_notes,
  (select count(*) from s_orders o where o.customer_id=c.customer_id) orders, (select count(*) from s_tickets t where t.customer_id=c.customer_id) support_tickets
from (select * from s_customers qualify row_number() over (partition by tenant_id order by md5(concat('42:',customer_id)), customer_id)<=3) c""",
        "rebase_dates": """
select tenant_id, order_id id, cast(order_date + cast(d as int) as date) "day", cast(shipping_date + cast(d as int) as date) second_day from s_orders join (select tenant_id, date '2026-04-09'-max(order_date) d from s_orders group by all) x using (tenant_id)
union all select tenant_id, fulfillment_event_id, cast(event_date + cast(d as int) as date), null from s_fulfil join (select tenant_id, date '2026-04-09'-max(order_date) d from s_orders group by all) x using (tenant_id)
union all select tenant_id, ticket_id, cast(date_of_purchase + cast(d as int) as date), null from s_tickets join (select tenant_id, date '2026-05-02'-max(date_of_purchase) d from s_tickets group by all) x using (tenant_id)""",
        "rebase_outcomes": """
select tenant_id, outcome_id, case when p then null else cast(low + cast(h%(greatest(date '2026-05-08'-low,0)+1) as int) as date) end outcome_date,
  case when p then 'Pending' else outcome_status end outcome_status, case when p then true else follow_up_required end follow_up_required
from (select o.*, cast(cast(reviewed_at as date)+1 as date) low, cast(concat('0x',substr(md5(concat('42:pending:',outcome_id)),1,8)) as bigint)%100<20 p,
    cast(concat('0x',substr(md5(concat('42:day:',outcome_id)),1,8)) as bigint) h from s_outcomes o left join s_reviews r on r.review_id=o.review_id and r.tenant_id=o.tenant_id) x""",
        "backfill_lineage": lineage(True),
        "backfill_lineage_overwrite": lineage(False),
        "email_refs": "select distinct e.tenant_id, email_id, ref from s_emails e join s_refs r on r.tenant_id=e.tenant_id and r.customer_id=e.customer_id and r.scenario=e.scenario and r.topic=e.topic where ref<>''",
        "lineage_refs": "select * from s_refs where ref<>''",
        "sample_by_band": volume_sample("s_emails", "email_id", 2, 20),
        "sample_notes_by_band": volume_sample("s_notes", "note_id", 1, 12),
        "spread_tickets": "select tenant_id, customer_id, ticket_id, customer_full_name, ticket_priority from s_spread",
        "rebuild_bridge": """
select tenant_id, cast(substr(ticket_id,2) as bigint) source_ticket_id, ticket_id, customer_id, source_customer_id, customer_full_name, '' support_customer_name, '' support_customer_email,
  'risk_redistribution_v2' mapping_method, 1.0::double mapping_confidence, 'spread_tickets: handed out by account risk' mapping_note from s_spread""",
        "repair_log": _repair_log(),
        "evidence_bundle": """
select c.tenant_id, c.customer_id, customer_email email, coalesce(p.n,0) prior_reviews, coalesce(orders_ids,'') recent_orders_ids, coalesce(tickets_ids,'') recent_tickets_ids,
  coalesce(notes_ids,'') recent_notes_ids, coalesce(emails_ids,'') recent_emails_ids, coalesce(fulfil_ids,'') fulfillment_events_ids
from s_customers c left join s_bundle using (tenant_id, customer_id) left join (select tenant_id, customer_id, least(5,count(*)) n from s_reviews group by all) p using (tenant_id, customer_id)""",
        "evidence_bundle_heldout": """
select k.tenant_id, k.customer_id, k.review_id, coalesce((select string_agg(strftime(reviewed_at,'%Y-%m-%d'), ',' order by rn) from
    (select *, row_number() over (partition by tenant_id, customer_id order by reviewed_at desc nulls last, review_id) rn from s_reviews) r
    where r.tenant_id=k.tenant_id and r.customer_id=k.customer_id and r.rn<=5 and r.review_id<>k.review_id),'') prior_dates,
  coalesce(notes_ids,'') recent_notes_ids, coalesce(citable,0) citable
from s_reviews k left join s_bundle using (tenant_id, customer_id)""",
        "labelled_reviews": "select * from s_labelled",
        "one_case_per_customer": "select * from s_cases",
        "stratified_sample": 'select tenant_id, customer_id, review_id, human_decision, "position" from s_sample20',
        "holdout": """
select * from (select tenant_id, customer_id, review_id, human_decision, outcome_status, follow_up_required, row_number() over (partition by tenant_id order by md5(concat('43:',review_id)), review_id) "position"
from (select *, row_number() over (partition by tenant_id, human_decision order by md5(concat('42:',review_id)), review_id) draw from s_labelled) x
join (select tenant_id, count(distinct human_decision) classes from s_labelled group by all) c using (tenant_id) where draw<=greatest(2,10//classes)) y where "position"<=10""",
        "label_cases": _case_texts(),
        "redact_notes": _redacted_cells(),
        "leak_check": _leaks(),
        "score_predictions": "select * replace (round(citation_validity,6) as citation_validity) from (select *, case when cited_count>0 then valid_citations/cited_count else 1.0 end citation_validity from s_scored) x",
        "eval_headline": """
select n, correct, parse_errors, agreed, no_outcome_data, model_vindicated, human_right_over, under_called, human_right_under, n-correct-no_outcome_data scorable_disagreements,
  round(correct/n,6) agreement, round((correct+model_vindicated)/n,6) outcome_alignment, round(cites/n,6) avg_citations, round(validity/n,6) avg_validity
from (select count(*) n, count(*) filter (decision_match) correct, count(*) filter (parse_error) parse_errors, sum(cited_count) cites,
    sum(case when cited_count>0 then valid_citations/cited_count else 1.0 end) validity, """ + ", ".join(
            f"count(*) filter (outcome_verdict='{v}') {v}" for v in ("agreed", "no_outcome_data", "model_vindicated", "human_right_over", "under_called", "human_right_under")) + " from s_scored) x",
        "confusion_matrix": """
select a.c actual, p.c predicted, count(s.review_id) "rows" from (select distinct actual_decision c from s_scored union select predicted_decision from s_scored where predicted_decision<>'') a
join (select distinct actual_decision c from s_scored union select predicted_decision from s_scored where predicted_decision<>'') p on true
left join s_scored s on s.actual_decision=a.c and s.predicted_decision=p.c group by all""",
        "agreement_by_class": """
select a.c "class", count(s.review_id) n, count(*) filter (decision_match) correct, case when count(s.review_id)>0 then round(count(*) filter (decision_match)/count(s.review_id),6) else 0.0 end agreement
from (select distinct actual_decision c from s_scored union select predicted_decision from s_scored where predicted_decision<>'') a left join s_scored s on s.actual_decision=a.c group by all""",
        "parse_predictions": """
select tenant_id, review_id, parse_error, case when parse_error then '' else predicted_decision end predicted_decision, case when parse_error then '' else predicted_band end predicted_band,
  case when parse_error then '' else trim(rationale) end rationale, case when parse_error then '' else array_to_string(cited,';') end cited,
  case when parse_error then least(500,length(reply)-1) end raw_kept
from (select *, json_object('predicted_decision',predicted_decision,'predicted_band',predicted_band,'rationale',rationale,'cited_record_ids',cited)::varchar reply from s_predictions) x""",
        "label_agreement": "select cast(coalesce(sum(n) filter (a=b),0) as bigint) hits, cast(coalesce(sum(n),0) as bigint) shared from s_pairs",
        "cohen_kappa": f"{KAPPA} from (select {AGREE} from s_pairs) x",
        "wilson_interval": WILSON,
        "per_class_prf": 'select "class", cast(support as bigint) support, round("precision",6) "precision", round(recall,6) recall, round(f1,6) f1 from s_rates',
        "macro_f1": "select count(*) classes, round(coalesce(avg(f1),0),6) macro_f1 from s_rates where support>0",
        "confusion_3x3": "select x actual, w predicted, coalesce(n,0) \"rows\" from (values ('Monitor'),('Stabilize'),('Escalate')) c(x) join (values ('Monitor'),('Stabilize'),('Escalate')) d(w) on true left join s_pairs on a=x and b=w",
        "majority_label": "select tenant_id, case_id, decision, v votes, al all_votes from (select tenant_id, case_id, decision, count(*) v, max(count(*)) over (partition by tenant_id, case_id) m, cast(sum(count(*)) over (partition by tenant_id, case_id) as bigint) al from s_votes group by tenant_id, case_id, decision) x where v=m qualify count(*) over (partition by tenant_id, case_id)=1",
        "labeler_pairs": f"{KAPPA}, la labeler_a, lb labeler_b from (select la, lb, {AGREE} from (select a.labeler la, b.labeler lb, a.decision a, b.decision b, count(*) n from s_votes a join s_votes b on a.tenant_id=b.tenant_id and a.case_id=b.case_id and a.labeler<b.labeler group by all) y group by la, lb) x",
        "synthetic_labels": "select tenant_id, review_id case_id, human_decision decision from s_reviews",
        "labelers_vs_synthetic": f"{KAPPA}, la labeler, labeled from (select la, {AGREE} from (select v.labeler la, v.decision a, r.human_decision b, count(*) n from s_votes v join s_reviews r on r.tenant_id=v.tenant_id and r.review_id=v.case_id group by all) y group by la) x join (select labeler, count(*) labeled from s_votes group by all) t on labeler=la",
        "label_report": _label_report(),
        "validate_proposals": """
select l.tenant_id, event_seq, l.customer_id, c.customer_full_name, action_type, case when trim(coalesce(payload_json,''))='' then '{}' when json_valid(payload_json) then payload_json
  else json_object('text',payload_json)::varchar end payload_json, greatest(0.0,least(1.0,confidence)) confidence, action_type<>'delete_account' and c.customer_id is not null accepted,
  case when action_type='delete_account' then 'unknown action type' when c.customer_id is null then 'unknown customer' end reject_reason
from (select * replace (case when event_seq%9=0 then concat(customer_id,'x') else customer_id end as customer_id) from s_ledger where event_type='propose') l
left join s_customers c on c.tenant_id=l.tenant_id and c.customer_id=l.customer_id""",
        "action_state": f"select {STATE} from s_state",
        "pending_actions": f"select {STATE}, {state_rank} \"rank\" from s_state where status='pending' qualify \"rank\"<=50",
        "decision_trail": "select * from s_trail",
        "decided_actions": """
select s.tenant_id, action_id, s.customer_full_name, status, s.decided_at, s.decided_by, decision_id, decision_notes, row_number() over (partition by s.tenant_id order by s.decided_at desc nulls last, action_id, decision_id) "rank"
from s_state s left join s_trail t on t.tenant_id=s.tenant_id and t.related_action_id=s.action_id where status in ('approved','rejected') qualify "rank"<=20""",
        "action_by_id": f"select {STATE} from s_state where action_id in ('A7-0','A7-1','A7-2','A7-3','A12-4','A12-5','A12-6','A149-7','A149-8','A149-9')",
        "sendable_emails": """
select tenant_id, action_id, customer_id, send_to, subject, reason is null sendable, reason from (select *, case when not json_valid(coalesce(payload_json,'{}')) then 'payload is not JSON'
    when send_to='' then 'no recipient' when not contains(send_to,'@') then 'recipient is not an address' when subject='' then 'no subject' end reason
  from (select *, coalesce(trim(case when json_valid(payload_json) then payload_json->>'$.to' end),'') send_to, coalesce(trim(case when json_valid(payload_json) then payload_json->>'$.subject' end),'') subject
    from s_state where action_type='send_email' and status='approved') x) y""",
        "dedupe_requests": """
select * from (select tenant_id, customer_id, scenario, topic, sentiment_hint, body, count(*) asked from s_emails where direction='user' group by all) u
where not exists (from s_emails m where m.direction='assistant' and m.tenant_id=u.tenant_id and m.customer_id=u.customer_id and m.scenario=u.scenario and m.topic=u.topic
  and m.sentiment_hint is not distinct from u.sentiment_hint and m.body is not distinct from u.body)""",
        "batch_sentiment": "select tenant_id, customer_id, on_day \"day\", count(*) filter (bucket='positive') positive, count(*) filter (bucket='neutral') neutral, count(*) filter (bucket='negative') negative, count(*) total from s_signals group by all",
    }
    sql["top_decile_revenue_bracketed"] = sql["top_decile_revenue"]
    for scanned in ("inventory", "dates", "columns"):
        sql[f"scanned_{scanned}"] = sql[f"audit_{scanned}"]
    for counted in ("fk_coverage", "audit_duplicates"):
        sql[f"{counted}_bitmaps"] = sql[counted]
    sql["scanned_patterns"] = sql["audit_pii_patterns"]
    sql["scanned_value_counts"] = sql["value_counts"]
    sql["evidence_bundle_bucketed"] = sql["evidence_bundle"]
    sql["search_accounts_indexed"] = sql["search_accounts"]
    sql["resolve_names_anew"] = sql["resolve_names"]
    sql["portfolio_kpis_anew"] = sql["portfolio_kpis"]
    sql["stream_action_state"] = sql["action_state"]
    sql["stream_sentiment"] = sql["batch_sentiment"]
    return sql


def all_oracles() -> dict[str, str]:
    out = {}
    for name, sql in statements().items():
        text = with_views(sql + (" " + NAME_VIEWS if name.startswith("resolve_names") else ""))
        if name.startswith("resolve_names"):
            views = with_views(NAME_VIEWS)
            head = views[: views.rindex(NAME_VIEWS.strip())].rstrip()
            text = f"{head},\n{NAME_VIEWS.strip()}\n{sql.strip()}"
        if name == "ref_resolution":
            extra = (
                "cited as (select 'customer_notes' table_name, tenant_id, source_signal_ids s from s_notes union all select 'customer_email_logs', tenant_id, source_signal_ids from s_emails),\n"
                "known as (select tenant_id, ticket_id id from s_tickets union select tenant_id, order_id from s_orders)"
            )
            views = with_views(extra)
            text = f"{views[: views.rindex(extra)].rstrip()},\n{extra}\n{sql.strip()}"
        out[name] = text
    return out
