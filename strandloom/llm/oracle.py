"""SQL of the same results for another engine, where SQL can express them."""

P1 = r"""
with f as (select upper(trim(fragment)) f, any_value(motif_len) k from fragments group by 1),
s as (select seq_id, arg_min(q_star, loaded_at) q, max(fragment) fragment from sequences where seq_id is not null group by 1),
p as (select seq_id, k, unnest(q) st, generate_subscripts(q,1)-1 pos from s left join f on f.f=upper(trim(s.fragment))),
m as (select *, coalesce(st<>0 and lag(st) over w<>0 and (st=lag(st) over w or coalesce(st+lag(st) over w=2*k+1,false)),false) same from p window w as (partition by seq_id order by pos)),
g as (select *, sum(case when same then 0 else 1 end) over (partition by seq_id order by pos) grp from m),
r1 as (select 'q_star' as field, seq_id, min(pos) run_start, count(*) run_count, count(*) run_duration from g group by seq_id, grp having count(*)>1),
t as (select site_id, arg_min(seq_id,loaded_at) seq_id, arg_min(found_at,loaded_at) found_at, arg_min(sites,loaded_at) sites from gettestdatasites where site_id is not null group by 1),
t2 as (select seq_id, site_id, found_at, lower(regexp_replace(sites,'^\s+|\s+$','','g')) x from t where seq_id is not null and found_at is not null),
t3 as (select *, lag(x) over (partition by seq_id order by found_at, site_id) y from t2),
t4 as (select *, coalesce(length(x)>0 and length(x)=length(y) and list_sum([case when x[i]<>y[i] and x[i]<>'n' and y[i]<>'n' then 1 else 0 end for i in range(1,length(x)+1)])<=1,false) same from t3),
t5 as (select *, sum(case when same then 0 else 1 end) over (partition by seq_id order by found_at, site_id) grp from t4),
r2 as (select 'sites' as field, seq_id, arg_min(site_id,(found_at,site_id)) run_start, count(*) run_count, cast(epoch(max(found_at))-epoch(min(found_at)) as bigint) run_duration from t5 group by seq_id, grp having count(*)>1)
select field, seq_id, run_start, run_count, run_duration from r1 union all select * from r2
"""

P2 = r"""
with h as (select count_id, seq_idx_membership s, pos, lower(trim(mer)) mer from mer_count_with_seq_membership where total>=1),
n as (select count_id, count(distinct s) n from h group by 1),
t as (select distinct a.count_id, a.s, a.mer mer1, b.mer mer2, c.mer mer3 from h a join h b on a.count_id=b.count_id and a.s=b.s and a.pos<b.pos join h c on c.count_id=a.count_id and c.s=a.s and b.pos<c.pos)
select count_id, mer1, mer2, mer3, count(*) support from t join n using (count_id) group by count_id, mer1, mer2, mer3, n having 5*count(*)>=n
"""

P3 = r"""
with r as (select fasta_id, lower(regexp_replace(arg_min(sequence,loaded_at),'\s','','g')) s from fasta where fasta_id is not null group by 1),
w as (select fasta_id, i, substr(s,i+1,40) k from (select fasta_id, s, unnest(range(0,length(s)-39)) i from r where length(s)>=40) ),
v as (select * from w where not regexp_matches(k,'[^acgt]')),
sh as (select k from v group by k having min(fasta_id)<>max(fasta_id)),
c as (select fasta_id, i from v where k in (select k from sh)),
g as (select *, case when i - lag(i) over (partition by fasta_id order by i) <= 40 then 0 else 1 end f from c),
h as (select *, sum(f) over (partition by fasta_id order by i) grp from g)
select fasta_id, min(i) span_start, max(i)+40 span_end from h group by fasta_id, grp
"""

P4 = r"""
with s as (select seq_id, nullif(trim(arg_min(fragment_training_set_filename,loaded_at)),'') tr, nullif(trim(arg_min(fragment_test_set_filename,loaded_at)),'') te, arg_min(seq,loaded_at) seq from sequences where seq_id is not null group by 1),
c as (select seq_id, tr is not null istr, try_cast(regexp_extract(trim(coalesce(tr,te)),'(\d+)\.[^.\\/]*$',1) as int) fold,
 regexp_replace(lower(regexp_replace(seq,'\s','','g')),'^n+|n+$','','g') t from s where coalesce(tr,te) is not null and seq is not null),
k as (select * from c where fold is not null and length(replace(t,'n',''))>=60),
p as (select a.seq_id x, b.seq_id y, a.t s, b.t u from k a join k b on a.fold=b.fold and a.istr and not b.istr and abs(length(a.t)-length(b.t))*100<=4*greatest(length(a.t),length(b.t)))
select least(x,y) seq_id_a, greatest(x,y) seq_id_b from p where levenshtein(s,u)*100<=4*greatest(length(s),length(u))
"""

P5 = r"""
with a as (select call_id, lower(trim(arg_min(_k_mers,loaded_at))) m from top_mers_callback group by 1),
b as (select case when regexp_full_match(m,'[acgt]+') then least(m, reverse(translate(m,'acgt','tgca'))) end mer from a),
c as (select mer_count_id, lower(trim(arg_min(mer,loaded_at))) m, coalesce(arg_min(total,loaded_at),0) t from mer_count group by 1),
e as (select case when regexp_full_match(m,'[acgt]+') then least(m, reverse(translate(m,'acgt','tgca'))) end mer, t from c)
select '_k_mers' field, mer from b where mer is not null group by mer having count(*)>=0.004*(select count(*) from b)
union all select 'total', mer from e where mer is not null group by mer having sum(t)>=0.005*(select sum(t) from e)
"""

P3_SHARE = f"""
with spans as ({P3}), r as (select fasta_id, coalesce(length(lower(regexp_replace(arg_min(sequence,loaded_at),'\\s','','g'))),0) n from fasta where fasta_id is not null group by 1),
c as (select fasta_id, sum(span_end-span_start) m from spans group by 1)
select fasta_id, n n_symbols, coalesce(m,0)::bigint n_shared, case when n>0 then round(coalesce(m,0)/n,6) end share from r left join c using (fasta_id)
"""

P4_REPORT = f"""
with pairs as ({P4}), hit as (select seq_id_a x from pairs union select seq_id_b from pairs),
t as (select seq_id, max(upper(trim(fragment))) fragment, nullif(trim(arg_min(fragment_training_set_filename,loaded_at)),'') tr, nullif(trim(arg_min(fragment_test_set_filename,loaded_at)),'') te from sequences where seq_id is not null group by 1)
select try_cast(regexp_extract(te,'(\\d+)\\.[^.\\\\/]*$',1) as int) fold, fragment, count(*) n_test, count(hit.x) n_leaked from t left join hit on hit.x=t.seq_id where tr is null and te is not null group by 1,2
"""

P5_COUNTS = """
with a as (select call_id, lower(trim(arg_min(_k_mers,loaded_at))) m from top_mers_callback group by 1),
b as (select case when regexp_full_match(m,'[acgt]+') then least(m, reverse(translate(m,'acgt','tgca'))) end mer from a),
c as (select mer_count_id, lower(trim(arg_min(mer,loaded_at))) m, coalesce(arg_min(total,loaded_at),0) t from mer_count group by 1),
e as (select case when regexp_full_match(m,'[acgt]+') then least(m, reverse(translate(m,'acgt','tgca'))) end mer, t from c)
select '_k_mers' field, mer, count(*)::bigint weight, (select count(*) from b)::bigint total from b where mer is not null group by mer having count(*)>=0.004*(select count(*) from b)
union all select 'total', mer, sum(t)::bigint, (select sum(t) from e)::bigint from e where mer is not null group by mer having sum(t)>=0.005*(select sum(t) from e)
"""


#: Named entities that the texts hold, the last one first decoded last; a number is decoded by its code (fixed values).
ENTITIES = (("&nbsp;?", " "), ("&#39;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
BBCODE = r"\[/?(?:b|i|u|s|quote|url|img|size|color|code|list|font|center|left|right|email|spoiler|sup|sub|table|tr|td|th|hr|pre|youtube|attach|\*)(?:[=\s][^\[\]]*)?\]"


def words(text: str) -> str:
    """Words of a text: entities decoded, tags blanked, unseen characters dropped, lower case, runs of letters and digits."""
    for entity, sign in ENTITIES:
        text = f"regexp_replace({text}, '{entity}', '{sign}', 'g')"
    text = rf"regexp_replace({text}, '</?[a-zA-Z][^<>]*>|<!--(?s:.*?)-->', ' ', 'g')"
    text = rf"regexp_replace({text}, '{BBCODE}', ' ', 'gi')"
    text = rf"regexp_replace({text}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}\x{{180E}}]', '', 'g')"
    return rf"regexp_extract_all(lower({text}), '[\pL\pN]+')"


P7 = f"""
with d as (select doc_id, {words('text')} w from documents where text is not null), i as (select item_id, {words('item_text')} w from eval_items where item_text is not null),
x as (select item_id, array_to_string(w[k:k+12], ' ') s from (select item_id, w, unnest(range(1, len(w) - 11)) k from i where len(w) >= 13)),
y as (select doc_id, array_to_string(w[k:k+12], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 11)) k from d where len(w) >= 13))
select distinct doc_id, item_id from y join x using (s)
"""


#: Diagonals with enough same words, all their stretches of 13 words or more with 80 % the same, and of these the ones within no other.
P7_OVERLAPS = f"""
with d as (select doc_id, {words('text')} w from documents where text is not null), i as (select item_id, {words('item_text')} w from eval_items where item_text is not null),
x as (select item_id, k q, w[k] word from (select item_id, w, unnest(range(1, len(w) + 1)) k from i)), y as (select doc_id, k p, w[k] word from (select doc_id, w, unnest(range(1, len(w) + 1)) k from d)),
m as (select doc_id, item_id, p - q shift, p from y join x using (word)),
g as (select doc_id, item_id, shift from m group by all having count(*) >= 11),
r as materialized (select m.*, row_number() over (partition by doc_id, item_id, shift order by p) k from m join g using (doc_id, item_id, shift)),
l as (select doc_id, item_id, shift, max(n) longest from (select doc_id, item_id, shift, count(*) n from r group by doc_id, item_id, shift, p - k) group by all),
s as materialized (select a.doc_id, a.item_id, a.shift, a.p b, z.p e, z.k - a.k + 1 n_same, z.p - a.p + 1 n_words from r a join r z using (doc_id, item_id, shift) where z.p - a.p >= 12 and 5 * (z.k - a.k + 1) >= 4 * (z.p - a.p + 1))
select doc_id, item_id, shift, b - 1 start, n_same, n_words, longest from s join l using (doc_id, item_id, shift)
where not exists (select 1 from s o where o.doc_id = s.doc_id and o.item_id = s.item_id and o.shift = s.shift and o.b <= s.b and o.e >= s.e and o.n_words > s.n_words)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_share": P3_SHARE, "p4_found": P4, "p4_report": P4_REPORT, "p5_found": P5, "p5_counts": P5_COUNTS, "p7_found": P7, "p7_overlaps": P7_OVERLAPS,
    }
