"""The customer book as SQL views over the source tables, for checking the queries."""

from __future__ import annotations

import re

# In dependency order.
VIEWS: dict[str, str] = {
    "s_people": """
select c_custkey k, concat('t',cast(n_regionkey as varchar)) tenant_id, concat('C',cast(c_custkey as varchar)) customer_id,
  concat(split_part('Mary,Pat,Ana,Lee,Omar,Ines,Kofi',',',cast(c_custkey%7+1 as int)),' ',
    split_part('Smith,Stone,Cruz,Okoro,Smithson,Lind,Yu,Park,Diaz,Moss,Hale',',',cast(c_custkey%11+1 as int))) customer_full_name,
  lower(concat(c_name,'@example.com')) customer_email, c_mktsegment customer_segment, n_name customer_country, c_acctbal, c_custkey source_customer_id, 'key' mapping_method
from customer join nation on c_nationkey=n_nationkey""",
    "s_line": """
select l_orderkey, cast(sum(cast(round(l_extendedprice*(1-l_discount),4) as decimal(18,4))) as double) order_total,
  cast(sum(cast(round(l_extendedprice*(l_tax-l_discount),4) as decimal(18,4))) as double) order_profit,
  max(cast(l_shipdate as date)) shipping_date,
  case when 2*sum(case when l_shipdate>o_orderdate then 1 else 0 end)>count(*) then 1 else 0 end late, count(*) order_item_count, cast(sum(l_quantity) as int) order_quantity
from lineitem join orders on l_orderkey=o_orderkey group by l_orderkey""",
    "s_orders": """
select tenant_id, concat('O',cast(o_orderkey as varchar)) order_id, customer_id, cast(o_orderdate as date) order_date, shipping_date,
  o_orderstatus order_status, case when late=1 then 'Late delivery' when late=0 then 'Shipping on time' end delivery_status,
  late late_delivery_risk, o_totalprice order_sales, order_profit, order_total, case when late=1 then 'Late' end issue_flag,
  o_orderkey source_order_id, k source_customer_id, order_item_count, order_quantity
from orders join s_people on o_custkey=k left join s_line on l_orderkey=o_orderkey""",
    "s_tickets": """
select tenant_id, concat('T',cast(event_id as varchar)) ticket_id, event_id source_ticket_id, customer_id, customer_full_name, k source_customer_id,
  cast(ts as date) date_of_purchase, split_part('Billing,Delivery,Product',',',cast(event_id%3+1 as int)) ticket_type,
  case when event_id%2=0 then concat('Case ',event_id) end ticket_subject, props ticket_description,
  case when event_id%11=0 then null else split_part('Open,Closed,Pending',',',cast(event_id%3+1 as int)) end ticket_status,
  split_part('Critical,High,Medium,Low',',',cast(event_id%4+1 as int)) ticket_priority,
  case when event_id%5=0 then null else split_part('Negative,Neutral,Positive,Frustrated,Dissatisfied,Unresolved,good',',',cast(event_id%7+1 as int)) end customer_sentiment,
  value resolution_time_hours
from events join s_people on user_id=k where event_type='error'""",
    "s_support_bridge": "select *, 'user' mapping_method, 1.0 mapping_confidence from s_tickets",
    "s_fulfil": """
select tenant_id, k source_customer_id, concat('F',cast(event_id as varchar)) fulfillment_event_id, customer_id, cast(ts as date) event_date,
  split_part('carrier_delay,cancellation_review',',',cast(event_id%2+1 as int)) event_type,
  split_part('High,Medium,Critical',',',cast(event_id%3+1 as int)) severity, case when event_id%3=0 then 'weather' end root_cause,
  case when event_id%13=0 then null else split_part('Open,Resolved,Closed,Unresolved',',',cast(event_id%4+1 as int)) end resolution_status
from events join s_people on user_id=k where event_type='purchase'""",
    "s_engage": """
select tenant_id, k source_customer_id, customer_full_name, concat('G',cast(event_id as varchar)) engagement_id, customer_id, cast(ts as date) event_date, event_type,
  case when event_id%4<>0 then concat('Campaign ',event_id%9) end campaign, split_part('web,email',',',cast(event_id%2+1 as int)) channel,
  value engagement_score
from events join s_people on user_id=k where event_type in ('view','click','signup')""",
    "s_emails": """
select tenant_id, k source_customer_id, concat('E',cast(conv_id as varchar),'-',cast(turn as varchar)) email_id, concat('TH',cast(conv_id as varchar)) thread_id,
  customer_id, customer_full_name, turn message_sequence, role direction, text body, case when turn=0 then concat('Thread ',conv_id) end subject,
  split_part('late_delivery_frustration,healthy_repeat_buyer',',',cast(conv_id%2+1 as int)) scenario, split_part('en,fr',',',cast(conv_id%2+1 as int)) topic,
  case when (conv_id+turn)%6=0 then null else split_part('Concerned,Neutral,Positive,Stable,Urgent',',',cast((conv_id+turn)%5+1 as int)) end sentiment_hint,
  date '2024-01-01' + cast(conv_id%30 as int) "date", case when conv_id%4=0 then concat('O',conv_id) end source_signal_ids
from conversations join s_people on conv_id=k""",
    "s_notes": """
select tenant_id, k source_customer_id, concat('N',cast(doc_id as varchar)) note_id, customer_id, customer_full_name,
  split_part('late_delivery_frustration,escalation_retention_case,healthy_repeat_buyer',',',cast(k%3+1 as int)) scenario,
  split_part('en,fr',',',cast(doc_id%2+1 as int)) topic, date '2024-01-01' + cast(doc_id%30 as int) note_date,
  case when doc_id%3<>0 then concat('Agent ',doc_id%5) end author,
  concat(customer_full_name,' late_delivery_recovery ',text) note_text,
  case when doc_id%9<>0 then concat('O',doc_id,'; T',doc_id*3,';') end source_signal_ids
from documents join s_people on doc_id//4=k""",
    "s_reviews": """
select tenant_id, k source_customer_id, concat('R',cast(doc_id as varchar)) review_id, doc_id, customer_id, customer_full_name,
  case when quality=1 then 'Monitor' when toxic=1 then 'Escalate' else 'Stabilize' end human_decision,
  cast(date '2024-01-01' + cast(doc_id%28 as int) as timestamp) reviewed_at,
  split_part('late_delivery_frustration,escalation_retention_case,healthy_repeat_buyer',',',cast(k%3+1 as int)) scenario,
  split_part('en,fr',',',cast(doc_id%2+1 as int)) topic, case when doc_id%5<>0 then concat('Lead ',doc_id%4) end reviewer,
  concat('Review of ',customer_full_name) review_notes
from labels join s_people on doc_id//4=k""",
    "s_outcomes": """
select tenant_id, k source_customer_id, customer_full_name, concat('U',cast(doc_id as varchar)) outcome_id, concat('R',cast(doc_id as varchar)) review_id, customer_id,
  date '2024-02-01' + cast(doc_id%20 as int) outcome_date, case when doc_id%5=0 then 'Pending' else 'Completed' end outcome_status,
  case when doc_id%11<>0 then toxic=1 end follow_up_required
from labels join s_people on doc_id//4=k where doc_id%7<>0""",
    "s_order_lines": """
select tenant_id, concat('L',l_orderkey,'-',l_linenumber) order_line_id, customer_id, concat('O',l_orderkey) order_id, l_orderkey source_order_id,
  k source_customer_id, l_partkey product_card_id, p_name product_name, p_type category_name, l_quantity quantity, p_retailprice product_price,
  l_extendedprice sales, l_discount discount_rate
from lineitem join orders on l_orderkey=o_orderkey join s_people on o_custkey=k left join part on p_partkey=l_partkey""",
    "s_adjustments": """
select tenant_id, concat('J',l_orderkey,'-',l_linenumber) adjustment_id, customer_id, cast(l_shipdate as date) created_date,
  k source_customer_id, customer_full_name, 'return' adjustment_type, l_extendedprice amount
from lineitem join orders on l_orderkey=o_orderkey join s_people on o_custkey=k where l_returnflag='R'""",
    "s_contacts": """
select coalesce(tenant_id,'t0') tenant_id, concat('K',s_suppkey) contact_id, concat('C',s_suppkey*20) customer_id, s_suppkey%4=0 synthetic_flag,
  customer_full_name, s_name contact_full_name, concat(lower(s_name),'@example.com') contact_email
from supplier left join s_people on s_suppkey*20=k""",
    "s_ledger": """
select tenant_id, concat('A',user_id,'-',event_id%16) action_id, customer_id, customer_full_name, ts event_ts, event_id event_seq,
  case event_type when 'signup' then 'propose' when 'click' then 'edit' when 'purchase' then 'decide' when 'error' then 'decide' else 'send' end event_type,
  case when event_type='signup' then split_part('send_email,proactive_outreach,reclassify_band,update_lifecycle,escalate,schedule_followup,recommend_credit,recommend_expedite,add_note,delete_account',',',cast(user_id%10+1 as int)) end action_type,
  case when event_type not in ('signup','click') then null when event_id%7=0 then null when event_id%7=1 then '  ' when event_id%7=2 then '{bad'
    when event_id%7=3 then concat('{"to":"user',user_id,'@example.com","subject":"About ',event_id,'"}')
    when event_id%7=4 then concat('{"to":"nobody","subject":"About ',event_id,'"}') when event_id%7=5 then '{"to":"a@example.com"}' else props end payload_json,
  case when event_type in ('purchase','error') and event_id%11=0 then 'maybe' when event_type='purchase' then 'approved' when event_type='error' then 'rejected' end status,
  case when event_type in ('purchase','error') then concat('U',event_id) end actor,
  case when event_type in ('purchase','error') and event_id%2=0 then 'checked' end remarks,
  case when event_type='signup' then concat('because ',event_id) end rationale, case when event_type='signup' then value/100 end confidence,
  case when event_type='view' and event_id%3=0 then 'mail server refused' end error
from events join s_people on user_id=k""",
    "s_sessions": """
select distinct tenant_id, concat('S',conv_id) session_id, customer_id, timestamp '2024-01-01' + to_days(cast(conv_id%30 as int)) started_at
from conversations join s_people on conv_id=k""",
    "s_messages": """
select concat('M',conv_id,'-',turn) message_id, concat('S',conv_id) session_id, role, text content,
  timestamp '2024-01-01' + to_days(cast(conv_id%30 as int)) + to_minutes(turn) created_at
from conversations""",
    "s_predictions": """
select tenant_id, customer_id, concat('R',cast(l.doc_id as varchar)) review_id,
  split_part('Monitor,Escalate,Stabilize,',',',cast((d.n_chars+l.doc_id)%4+1 as int)) predicted_decision,
  split_part('Critical,High,Moderate,Low,Medium',',',cast(l.doc_id%5+1 as int)) predicted_band, concat(' because of ',l.doc_id,' ') rationale,
  case when l.doc_id%10=0 then [] when l.doc_id%3=0 then [concat('N',l.doc_id),concat('O',l.doc_id),'X1','X1']
    else [concat('N',l.doc_id),concat('N',l.doc_id),concat('O',l.doc_id)] end cited, d.n_chars%4=3 parse_error
from labels l join documents d on d.doc_id=l.doc_id join s_people on l.doc_id//4=k""",
    "s_votes": """
select tenant_id, 'a' labeler, review_id case_id, human_decision decision from s_reviews
union all select tenant_id, 'b', review_id, predicted_decision from s_predictions where predicted_decision<>''
union all select tenant_id, 'c', review_id, split_part('Monitor,Stabilize,Escalate,Monitor',',',cast(doc_id%4+1 as int)) from s_reviews""",
    "s_customers": """
select *, 100-2*risk_score health_score,
  case when risk_score>=50 then 'Critical' when risk_score>=38 then 'High' when risk_score>=30 then 'Moderate' when risk_score>=24 then 'Elevated'
    when risk_score>=15 then 'Low' when risk_score is null then null else 'Medium' end risk_band,
  case when k%7=0 then '  ' when k%7=1 then null when risk_score>=38 then 'high risk score' else '' end churn_risk_reason,
  case when total_orders>9 then 'Active' else 'Onboarding' end lifecycle_stage,
  case when k%3=0 then 'Call' when k%3=1 then 'Email' end next_best_action
from (select *, case when k%97=0 then null else 1.0e0*floor(60*coalesce(late_delivery_rate,0)
    + 25*(cast(open_support_ticket_count as double)/(1+open_support_ticket_count)) + case when c_acctbal<0 then 15 else 0 end) end risk_score
  from (select c.*, coalesce(n_orders,0) total_orders, case when k%50=0 then null else sales end total_sales, profit total_profit,
      coalesce(late_n,0) late_delivery_count, coalesce(late_n,0)/cast(n_orders as double) late_delivery_rate, coalesce(t.n,0) support_ticket_count, coalesce(open_n,0) open_support_ticket_count
    from s_people c
    left join (select customer_id, count(*) n_orders, cast(sum(cast(order_sales as decimal(18,2))) as double) sales,
        cast(sum(cast(order_profit as decimal(18,4))) as double) profit, cast(sum(late_delivery_risk) as bigint) late_n from s_orders group by customer_id) o on o.customer_id=c.customer_id
    left join (select customer_id, count(*) n, cast(sum(case when ticket_status not ilike '%closed%' then 1 else 0 end) as bigint) open_n
      from s_tickets group by customer_id) t on t.customer_id=c.customer_id) c0) c1""",
    "s_signals": """
select *, case when {positive} then 'positive' when {negative} then 'negative' else 'neutral' end bucket,
  case when {negative} then 'negative' when {positive} then 'positive' else 'neutral' end strict_bucket
from (select tenant_id, customer_id, email_id signal_id, lower(sentiment_hint) signal, "date" as on_day from s_emails where sentiment_hint is not null
  union all select tenant_id, customer_id, ticket_id, lower(customer_sentiment), date_of_purchase from s_tickets where customer_sentiment is not null) x""",
    "s_moods": """
select tenant_id, customer_id, count(*) filter (bucket='positive') positive, count(*) filter (bucket='neutral') neutral,
  count(*) filter (bucket='negative') negative, count(*) total from s_signals group by all""",
    "s_summary": """
select tenant_id, count(*) total_customers, count(*) filter (risk_band ilike '%critical%') critical_count, count(*) filter (risk_band ilike '%high%') high_count,
  count(*) filter (risk_band ilike '%moderate%' or risk_band ilike '%elevated%') moderate_count, count(*) filter (risk_band ilike '%low%') low_count,
  coalesce(avg(risk_score),0) avg_risk_score, coalesce(avg(health_score),0) avg_health_score,
  coalesce(sum(total_sales),0) total_revenue, coalesce(sum(total_profit),0) total_profit,
  coalesce(sum(case when risk_band ilike '%critical%' or risk_band ilike '%high%' then total_sales else 0 end),0) revenue_at_risk,
  coalesce(avg(late_delivery_rate),0) avg_late_delivery_rate,
  count(*) filter (churn_risk_reason is not null and trim(churn_risk_reason)<>'') churn_flag_count,
  cast(sum(coalesce(open_support_ticket_count,0)) as bigint) open_ticket_backlog,
  count(*) filter (coalesce(risk_band,'Medium')='Medium') other_count,
  any_value(top10) revenue_top10
from s_customers join (select tenant_id tid, coalesce(sum(total_sales),0) top10 from
  (select tenant_id, total_sales, ntile(10) over (partition by tenant_id order by coalesce(total_sales,0) desc) tile from s_customers) x
  where tile=1 group by tenant_id) d on tid=tenant_id group by tenant_id""",
    "s_followups": """
select *, row_number() over (partition by tenant_id order by risk_score desc nulls last, reviewed_at desc nulls last, review_id, outcome_id nulls last) "rank"
from (select r.tenant_id, r.customer_id, r.review_id, r.reviewed_at, r.human_decision, o.outcome_id, o.outcome_status, o.follow_up_required, o.outcome_date,
    c.risk_band, c.risk_score, c.next_best_action
  from s_reviews r left join s_outcomes o on o.review_id=r.review_id and o.tenant_id=r.tenant_id
  left join s_customers c on c.customer_id=r.customer_id and c.tenant_id=r.tenant_id
  where o.outcome_status='Pending' or o.follow_up_required or o.outcome_id is null) x""",
    "s_alive": """
select l.* from s_ledger l join (select tenant_id, action_id, min((event_ts,event_seq)) proposed from s_ledger where event_type='propose' group by all) p
  using (tenant_id, action_id)
where (event_ts,event_seq)=proposed or ((event_ts,event_seq)>proposed and event_type<>'propose' and (event_type<>'decide' or coalesce(status in ('approved','rejected'),false)))""",
    "s_effective": """
select a.* from s_alive a left join (select tenant_id, action_id, min((event_ts,event_seq)) decided from s_alive where event_type='decide' group by all) d
  using (tenant_id, action_id)
where event_type<>'edit' or decided is null or (event_ts,event_seq)<decided""",
    "s_last": """
select tenant_id, action_id, customer_id, customer_full_name, event_type kind, event_ts, event_seq, action_type, payload_json, status, actor, remarks, rationale, confidence, error
from s_effective qualify row_number() over (partition by tenant_id, action_id, event_type order by event_ts desc, event_seq desc)=1""",
    "s_state": """
select p.tenant_id, p.action_id, p.customer_id, p.customer_full_name, p.action_type, case when e.kind is not null then e.payload_json else p.payload_json end payload_json,
  coalesce(d.status,'pending') status, p.event_ts created_at, d.event_ts decided_at, d.actor decided_by, p.rationale, p.confidence,
  case when s.error is null then s.event_ts end sent_at, s.error send_error
from (select * from s_last where kind='propose') p
left join (select * from s_last where kind='edit') e using (tenant_id, action_id)
left join (select * from s_last where kind='decide') d using (tenant_id, action_id)
left join (select * from s_last where kind='send') s using (tenant_id, action_id)""",
    "s_trail": """
select tenant_id, concat('DEC-',event_seq) decision_id, customer_id, customer_full_name, status decision, actor decided_by, event_ts decided_at, remarks decision_notes,
  action_id related_action_id from s_effective where event_type='decide'""",
    "s_recent5": """
select tenant_id, customer_id, 'orders' feed, order_id id, row_number() over (partition by tenant_id, customer_id order by order_date desc nulls last, order_id) rn from s_orders
union all select tenant_id, customer_id, 'tickets', ticket_id, row_number() over (partition by tenant_id, customer_id order by date_of_purchase desc nulls last, ticket_id) from s_tickets
union all select tenant_id, customer_id, 'notes', note_id, row_number() over (partition by tenant_id, customer_id order by note_date desc nulls last, note_id) from s_notes
union all select tenant_id, customer_id, 'emails', email_id, row_number() over (partition by tenant_id, customer_id order by "date" desc nulls last, message_sequence desc nulls last, email_id) from s_emails
union all select tenant_id, customer_id, 'fulfil', fulfillment_event_id, row_number() over (partition by tenant_id, customer_id order by event_date desc nulls last, fulfillment_event_id) from s_fulfil""",
    "s_bundle": """
select tenant_id, customer_id, coalesce(string_agg(id, ',' order by rn) filter (feed='orders'),'') orders_ids, coalesce(string_agg(id, ',' order by rn) filter (feed='tickets'),'') tickets_ids,
  coalesce(string_agg(id, ',' order by rn) filter (feed='notes'),'') notes_ids, coalesce(string_agg(id, ',' order by rn) filter (feed='emails'),'') emails_ids,
  coalesce(string_agg(id, ',' order by rn) filter (feed='fulfil'),'') fulfil_ids, count(distinct id) citable
from s_recent5 where rn<=5 group by all""",
    "s_labelled": """
select r.tenant_id, r.customer_id, r.review_id, r.human_decision, r.scenario, r.topic, r.reviewed_at, o.outcome_status, o.follow_up_required
from s_reviews r left join s_outcomes o on o.review_id=r.review_id and o.tenant_id=r.tenant_id where human_decision is not null""",
    "s_cases": """
select tenant_id, customer_id, review_id, human_decision, reviewed_at from s_reviews where human_decision is not null
qualify row_number() over (partition by tenant_id, customer_id order by review_id)=1""",
    "s_sample20": """
select tenant_id, customer_id, review_id, human_decision, reviewed_at, row_number() over (partition by tenant_id order by md5(concat('8:',review_id)), review_id) "position"
from (select *, row_number() over (partition by tenant_id, human_decision order by md5(concat('7:',review_id)), review_id) draw,
  from s_cases) x join (select tenant_id, count(distinct human_decision) classes from s_cases group by all) c using (tenant_id)
where draw <= 20//classes""",
    "s_scored": """
select tenant_id, customer_id, review_id, actual_decision, predicted_decision, predicted_band,
  lower(predicted_decision)=lower(actual_decision) and predicted_decision<>'' decision_match, len(cited) cited_count,
  len(list_filter(cited, lambda x: list_contains(valid, x))) valid_citations, parse_error, follow_up_required, outcome_status,
  case when lower(predicted_decision)=lower(actual_decision) then 'agreed' when follow_up_required is null then 'no_outcome_data'
    when plevel>alevel and follow_up_required then 'model_vindicated' when plevel>alevel then 'human_right_over'
    when plevel<alevel and follow_up_required then 'under_called' else 'human_right_under' end outcome_verdict,
  plevel>alevel model_more_active, plevel<alevel model_less_active, trim(rationale) rationale
from (select p.*, t.human_decision actual_decision, t.outcome_status, t.follow_up_required, coalesce(v.ids,[]) valid,
    case lower(p.predicted_decision) when 'monitor' then 1 when 'stabilize' then 2 when 'escalate' then 3 else 0 end plevel,
    case lower(t.human_decision) when 'monitor' then 1 when 'stabilize' then 2 when 'escalate' then 3 else 0 end alevel
  from s_predictions p join s_labelled t on t.review_id=p.review_id and t.tenant_id=p.tenant_id
  left join (select tenant_id, customer_id, list(id) ids from s_recent5 where rn<=5 group by all) v on v.tenant_id=t.tenant_id and v.customer_id=t.customer_id) x""",
    "s_pairs": """
select a.decision a, b.decision b, count(*) n from s_votes a join s_votes b on a.tenant_id=b.tenant_id and a.case_id=b.case_id
where a.labeler='a' and b.labeler='b' group by all""",
    "s_prf": """
select d "class", coalesce(sum(n) filter (a=d),0) support, coalesce(sum(n) filter (a=d and b=d),0) tp, coalesce(sum(n) filter (b=d),0) called
from (values ('Monitor'),('Stabilize'),('Escalate')) c(d) left join s_pairs on a=d or b=d group by d""",
    "s_rates": """
select "class", support, case when called>0 then tp/called else 0.0 end "precision", case when support>0 then tp/support else 0.0 end recall,
  case when tp>0 then 2.0*(tp/called)*(tp/support)/((tp/called)+(tp/support)) else 0.0 end f1 from s_prf""",
    "s_refs": """
select distinct tenant_id, customer_id, scenario, topic, unnest(string_split(source_signal_ids,';')) ref from s_notes where source_signal_ids is not null""",
    "s_lineage": """
select tenant_id, customer_id, scenario, topic, string_agg(ref, ';' order by ref) refs, count(*) n from s_refs where ref<>'' group by all""",
    "s_spread": """
select t.tenant_id, c.customer_id, c.customer_full_name, c.k source_customer_id, t.ticket_id, t.ticket_priority
from (select *, row_number() over (partition by tenant_id order by case ticket_priority when 'Critical' then 0 when 'High' then 1 when 'Low' then 3 else 2 end, ticket_id) slot from s_tickets) t
join (select *, (upto-share)*tickets//shares lo, upto*tickets//shares hi from
  (select *, sum(share) over (partition by tenant_id order by risk_score desc nulls last, customer_id rows unbounded preceding) upto from
    (select *, case when sum(target) over (partition by tenant_id)=0 then 1 else target end share,
        case when sum(target) over (partition by tenant_id)=0 then count(*) over (partition by tenant_id) else sum(target) over (partition by tenant_id) end shares from
      (select tenant_id, customer_id, customer_full_name, k, risk_score, case when risk_band ilike '%critical%' then 4+h%3 when risk_band ilike '%high%' then 2+h%3
          when risk_band ilike '%elevated%' or risk_band ilike '%moderate%' then 1+h%2 when h%10=9 then 1 else 0 end target
        from (select *, cast(concat('0x',substr(md5(concat('42:tickets:',customer_id)),1,8)) as bigint) h from s_customers) a) b) c) d
  join (select tenant_id, count(*) tickets from s_tickets group by all) n using (tenant_id)) c
  on c.tenant_id=t.tenant_id and t.slot>c.lo and t.slot<=c.hi""",
}

POSITIVE = "contains(signal,'posit') or contains(signal,'happy') or contains(signal,'satisf') or contains(signal,'pleas') or signal='good' or contains(signal,'stable') or contains(signal,'resolved') or contains(signal,'delight')"
NEGATIVE = "contains(signal,'negat') or contains(signal,'concern') or contains(signal,'frust') or contains(signal,'angry') or contains(signal,'upset') or contains(signal,'critical') or contains(signal,'dissat') or contains(signal,'urgent')"
VIEWS["s_signals"] = VIEWS["s_signals"].replace("{positive}", POSITIVE).replace("{negative}", NEGATIVE)


def with_views(sql: str) -> str:
    """The statement with the views it needs in front of it."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bs_[a-z0-9_]+\b", todo.pop()):
            if name in VIEWS and name not in needed:
                needed.add(name)
                todo.append(VIEWS[name])
    views = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in VIEWS if n in needed)
    return f"with {views}\n{sql.strip()}" if views else sql.strip()
