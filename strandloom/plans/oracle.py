"""SQL of the core's queries for an independent engine, written from the definitions.

Models enter as VALUES of their probabilities. Recursions over sequences are
recursive queries.
"""

from __future__ import annotations

import numpy as np

from ..models.hidden import HiddenModel
from .queries import MER, MODEL, MOTIF, OTHER, ROWS, SEED, SWEEP, SWEPT

EVENTS = """select user_id seq_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int t,
 case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 else 5 end o
 from events where user_id is not null"""
ORDERS = """select o_custkey seq_id, (row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1)::int t,
 coalesce(try_cast(substr(o_orderpriority, 1, 1) as int) - 1, 5) o from orders where o_custkey is not null"""
DIGITS = "translate(regexp_replace(lower({0}), '[^acgt]', 'n', 'g'), 'acgtn', '01234')"
FASTA = rf"""select seq_id, fragment, seq, {DIGITS.format('seq')} digits from (
 select fasta_id seq_id, max(fragment) fragment, lower(regexp_replace(arg_min(sequence, loaded_at), '\s', '', 'g')) seq from fasta where fasta_id is not null group by 1)"""
DNA = f"""select seq_id, i::int t, substr(digits, i + 1, 1)::int o from (select seq_id, digits, unnest(range(length(digits))) i from ({FASTA}))"""
INPUTS = rf"""select s.*, f.motif_len k, {DIGITS.format('t0')} digits from (
 select seq_id, max(fragment) fragment, arg_min(fragment_training_set_filename, loaded_at) train, arg_min(fragment_test_set_filename, loaded_at) test,
 regexp_replace(lower(regexp_replace(arg_min(seq, loaded_at), '\s', '', 'g')), '^n+|n+$', '', 'g') t0, arg_min(q_star, loaded_at) path
 from sequences where seq_id is not null group by 1) s left join fragments f on f.fragment = s.fragment"""
STATES = f"""select seq_id, fragment, t::int t, path[t + 1] q, try_cast(nullif(substr(digits, t + 1, 1), '') as int) o from (
 select *, unnest(range(len(path))) t from ({INPUTS}) where path is not null)"""
GIVEN_SITES = """select distinct seq_id, start, start + n "end" from (
 select site_id, arg_min(seq_id, loaded_at) seq_id, arg_min(start, loaded_at) start, length(trim(arg_min(sites, loaded_at))) n from gettestdatasites where site_id is not null group by 1)
 where seq_id is not null and start is not null and n > 0"""


def islands(rows: str, inside: str) -> str:
    """Half-open runs of ``inside`` in ``rows`` (seq_id, t, ...)."""
    return f"""select seq_id, min(t) start, max(t) + 1 "end" from (
 select seq_id, t, t - row_number() over (partition by seq_id order by t) g from ({rows}) where {inside}) group by seq_id, g"""


ISLANDS = islands(f"select * from ({STATES}) where seq_id in (select seq_id from ({INPUTS}) where digits is not null)", "q is not null and q <> 0")


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if not isinstance(x, float) else f"{x!r}::double" for x in r) + ")" for r in rows)


def model_tables(m: HiddenModel) -> str:
    pi = values([(i, float(p)) for i, p in enumerate(m.pi)])
    a = values([(i, j, float(m.a[i, j])) for i in range(m.states) for j in range(m.states) if m.a_at[i, j] >= 0])
    b = values([(i, k, float(m.b_unknown[i, k])) for i in range(m.states) for k in range(m.symbols + 1)])
    return f"pi(i, p) as (values {pi}), a(i, j, p) as (values {a}), b(i, k, p) as (values {b})"


def forward(view: str, m: HiddenModel) -> str:
    return f"""with recursive s as materialized ({view}), {model_tables(m)}, last as (select seq_id, max(t) t from s group by 1),
f(seq_id, t, i, x) as (
 select s.seq_id, 0, pi.i, pi.p * b.p from s, pi, b where s.t = 0 and b.i = pi.i and b.k = s.o
 union all
 select s.seq_id, s.t, a.j, sum(f.x * a.p) * any_value(b.p) from f join a on a.i = f.i join s on s.seq_id = f.seq_id and s.t = f.t + 1 join b on b.i = a.j and b.k = s.o group by s.seq_id, s.t, a.j),
ll as (select f.seq_id, ln(sum(x)) ll from f join last using (seq_id, t) group by 1)"""


def backward(m: HiddenModel) -> str:
    return """g(seq_id, t, i, x) as (
 select last.seq_id, last.t, pi.i, 1::double from last, pi
 union all
 select s.seq_id, g.t - 1, a.i, sum(a.p * b.p * g.x) from g join s on s.seq_id = g.seq_id and s.t = g.t and g.t > 0 join a on a.j = g.i join b on b.i = g.i and b.k = s.o group by s.seq_id, g.t, a.i)"""


def viterbi(view: str, m: HiddenModel) -> str:
    return f"""with recursive s as materialized ({view}), {model_tables(m)}, last as (select seq_id, max(t) t from s group by 1),
v(seq_id, t, i, x, psi) as (
 select s.seq_id, 0, pi.i, ln(pi.p) + ln(b.p), -1 from s, pi, b where s.t = 0 and b.i = pi.i and b.k = s.o and pi.p > 0 and b.p > 0
 union all
 select s.seq_id, s.t, a.j, max(v.x + ln(a.p)) + any_value(ln(b.p)), arg_max(v.i, (v.x + ln(a.p), v.i))
 from v join a on a.i = v.i and a.p > 0 join s on s.seq_id = v.seq_id and s.t = v.t + 1 join b on b.i = a.j and b.k = s.o and b.p > 0 group by s.seq_id, s.t, a.j),
vm as materialized (select * from v),
fin as (select seq_id, t, arg_max(i, (x, -i)) q, max(x) log_p from vm join last using (seq_id, t) group by 1, 2),
path(seq_id, t, q) as (
 select seq_id, t, q from fin
 union all
 select vm.seq_id, vm.t - 1, vm.psi from path join vm on vm.seq_id = path.seq_id and vm.t = path.t and vm.i = path.q where vm.t > 0)"""


CHAIN = f"""ev as ({EVENTS}),
w as (select seq_id, t, o, lag(o) over p o1, lag(o, 2) over p o2 from ev window p as (partition by seq_id order by t)),
c as (select 0 ord, o code from w union all select 1, o1 * 5 + o from w where o1 is not null union all select 2, o2 * 25 + o1 * 5 + o from w where o2 is not null),
dom as (select 0 ord, i code from range(5) x(i) union all select 1, i from range(25) x(i) union all select 2, i from range(125) x(i)),
tab as (select dom.ord, dom.code, dom.code // 5 ctx, (dom.code % 5)::int sym, 1.0::double + count(c.code) cnt from dom left join c on c.ord = dom.ord and c.code = dom.code group by all),
pr as (select *, cnt / sum(cnt) over (partition by ord, ctx) p, ln(cnt / sum(cnt) over (partition by ord, ctx)) logp from tab)"""
EVAL = f"""{CHAIN}, e as (select w.seq_id, w.t, pr.logp from w join pr on pr.ord = least(w.t, 2) and pr.code = case least(w.t, 2) when 0 then o when 1 then o1 * 5 + o else o2 * 25 + o1 * 5 + o end)"""


def mers(k: int) -> str:
    return f"select seq_id, substr(digits, i + 1, {k}) mer from (select seq_id, digits, unnest(range(length(digits) - {k - 1})) i from ({FASTA}) where length(digits) >= {k})"


ONE = "case when contains(mer, '4') then 'N' else least(mer, reverse(translate(mer, '0123', '3210'))) end"
REVCOMP = f"select mer, count(*) total, count(distinct seq_id) num_seqs from (select seq_id, {ONE} mer from ({mers(6)})) group by 1"


#: Log scores of the motif as rows ``pos, sym, x``, the fifth symbol for an unknown, and those of its other strand.
SCORES = f"""(select pos, sym, ln(p) x from (values {values([(i, j, float(p)) for i, row in enumerate(ROWS) for j, p in enumerate(row)])}) r(pos, sym, p)
 union all select pos, 4, ln(0.25) from range({len(ROWS)}) q(pos))"""


def other_strand(scores: str, size: int) -> str:
    return f"(select {size - 1} - pos pos, case when sym = 4 then 4 else 3 - sym end sym, x from {scores})"


def windows(scores: str, size: int) -> str:
    return f"""select seq_id, start, sum(x order by pos) score from (
 select d.seq_id, (d.t - m.pos)::int start, m.x, m.pos from ({DNA}) d join {scores} m on m.sym = d.o)
 where start >= 0 group by seq_id, start having count(*) = {size}"""


SITE_DNA = f"""select site_id, i::int t, substr(digits, i + 1, 1)::int o from (select site_id, digits, unnest(range(length(digits))) i from (
 select site_id, {DIGITS.format("trim(arg_min(sites, loaded_at))")} digits from gettestdatasites where site_id is not null group by 1))"""
FREQ = f"""select t pos, o sym, count(*) / sum(count(*)) over (partition by t) p from ({SITE_DNA}) where o < 4 group by t, o"""
FREQ_ALL = f"""select t pos, o sym, count(*) / sum(count(*)) over (partition by t) p from ({DNA}) where o < 4 group by t, o"""
EMIT = f"select fragment, q state, o sym, count(*) / sum(count(*)) over (partition by fragment, q) p from ({STATES}) where fragment is not null and q is not null and o < 4 group by fragment, q, o"
U = "('0x' || substr(md5(concat_ws(':', '{0}', {1})), 1, 8))::bigint / 4294967296.0::double"
CONFUSION = "count(*) filter ({0} and {1}) tp, count(*) filter (not {0} and not {1}) tn, count(*) filter (not {0} and {1}) fp, count(*) filter ({0} and not {1}) fn"
OVERLAP = f"""select a.seq_id, a.start a_start, a."end" a_end, b.start b_start, b."end" b_end, greatest(a.start, b.start) o_start, least(a."end", b."end") o_end
 from ({GIVEN_SITES}) a join ({ISLANDS}) b on a.seq_id = b.seq_id and a.start < b."end" and b.start < a."end" """


def start_value() -> str:
    """A mer with an unknown at either side, and the same with another in its middle."""
    parts = []
    for letters in (f"n{MER}n", f"n{MER[:2]}n{MER[2:]}n"):
        k = len(letters)
        weight = f"(0.4 + (substr('{letters}', pos::int + 1, 1) = substr('acgt', sym::int + 1, 1))::int) / (1.6 + (substr('{letters}', pos::int + 1, 1) <> 'n')::int)"
        scores = f"(select pos, sym, ln({weight}) x from range({k}) a(pos), range(4) b(sym) union all select pos, 4, ln(0.25) from range({k}) a(pos))"
        parts += [f"select seq_id, max(score) s from ({windows(x, k)}) group by 1" for x in (scores, other_strand(scores, k))]
    ids = f"select seq_id, 8 * ln(0.25) s from ({FASTA}) where digits is not null"
    return f"select '{MER}' mer, round(sum(s), 4) value from (select seq_id, max(s) s from ({' union all '.join([*parts, ids])}) group by 1)"


def sampled() -> str:
    def cumulated(rows: np.ndarray, kind: str) -> str:
        return values([(i, j, float(x)) for i, row in enumerate(np.cumsum(np.atleast_2d(rows), axis=1)) for j, x in enumerate(row)])

    def u(what: str) -> str:
        return U.format(SEED, f"n.seq_id::varchar, '{what}', {{t}}::varchar")

    pick = "(select least(count(*), {n}) from {tab} c where c.i = {i} and c.c <= {u})::int"
    q0 = pick.format(n=MODEL.states - 1, tab="cpi", i="0", u=u("q").format(t="0"))
    q1 = pick.format(n=MODEL.states - 1, tab="ca", i="x.q", u=u("q").format(t="(x.t + 1)"))
    o0 = pick.format(n=MODEL.symbols - 1, tab="cb", i="y.q", u=u("o").format(t="y.t").replace("n.seq_id", "y.seq_id"))
    return f"""with recursive cpi(i, j, c) as (values {cumulated(MODEL.pi, 'pi')}), ca(i, j, c) as (values {cumulated(MODEL.a, 'a')}), cb(i, j, c) as (values {cumulated(MODEL.b, 'b')}),
n as (select seq_id, count(*) n from ({ORDERS}) group by 1),
x(seq_id, t, q) as (select seq_id, 0, {q0} from n union all select n.seq_id, x.t + 1, {q1} from x join n using (seq_id) where x.t + 1 < n.n),
y as materialized (select * from x)
select seq_id, string_agg(q::varchar, '' order by t) states, string_agg(o::varchar, '' order by t) symbols from (select seq_id, t, q, {o0} o from y) group by 1"""


def em(hard: bool) -> str:
    """Cells ``part, cell, value`` of sums over all orders' sequences."""
    n, m = MODEL.states, MODEL.symbols
    if hard:
        return f"""{viterbi(ORDERS, MODEL)}, p as (select path.seq_id, path.t, path.q, s.o, lead(path.q) over (partition by path.seq_id order by path.t) nx from path join s using (seq_id, t)),
cells as (select 'pi' part, q cell, count(*)::double value from p where t = 0 group by 2 union all select 'a', q * {n} + nx, count(*)::double from p where nx is not null group by 2
 union all select 'b', q * {m} + o, count(*)::double from p where o < {m} group by 2)"""
    return f"""{forward(ORDERS, MODEL)}, {backward(MODEL)},
gam as (select f.seq_id, f.t, f.i, f.x * g.x / exp(ll.ll) p from f join g using (seq_id, t, i) join ll using (seq_id)),
cells as (select 'pi' part, i cell, sum(p) value from gam where t = 0 group by 2
 union all select 'b', gam.i * {m} + s.o, sum(gam.p) from gam join s using (seq_id, t) where s.o < {m} group by 2
 union all select 'a', a.i * {n} + a.j, sum(f.x * a.p * b.p * g.x / exp(ll.ll)) from f join a on a.i = f.i join s on s.seq_id = f.seq_id and s.t = f.t + 1 join b on b.i = a.j and b.k = s.o
  join g on g.seq_id = f.seq_id and g.t = f.t + 1 and g.i = a.j join ll on ll.seq_id = f.seq_id group by 2
 union all select 'll', 0, sum(ll) from ll)"""


def forward_scaled(view: str, m: HiddenModel) -> str:
    """The same for long sequences: known symbols count ``m.alphabet`` times, which is taken off at the end."""
    return f"""with recursive s as materialized (select *, case when o < {m.symbols} then {m.alphabet}::double else 1 end w from ({view})), {model_tables(m)}, last as (select seq_id, max(t) t, sum(ln(w)) w from s group by 1),
f(seq_id, t, i, x) as (
 select s.seq_id, 0, pi.i, pi.p * b.p * s.w from s, pi, b where s.t = 0 and b.i = pi.i and b.k = s.o
 union all
 select s.seq_id, s.t, a.j, sum(f.x * a.p) * any_value(b.p * s.w) from f join a on a.i = f.i join s on s.seq_id = f.seq_id and s.t = f.t + 1 join b on b.i = a.j and b.k = s.o group by s.seq_id, s.t, a.j),
ll as (select f.seq_id, ln(sum(x)) - any_value(w) ll from f join last using (seq_id, t) group by 1)"""


def training(view: str, m: HiddenModel, hard: bool, rounds: int) -> str:
    """``s, last, h(r, ll), stop(r)`` and ``pi, a, b`` of every round: ``rounds`` iterations, each with the model of the one before."""
    parts = [f"with recursive s as materialized ({view})", "last as materialized (select seq_id, max(t) t from s group by 1)"]
    parts += [x for x in model_tables(m).replace("pi(i", "pi0(i", 1).replace(" a(i, j", " a0(i, j", 1).replace(" b(i, k", " b0(i, k", 1).split("\x00")]
    for r in range(rounds):
        pi, a, b = f"pi{r}", f"a{r}", f"b{r}"
        if hard:
            parts += [
                f"""v{r}(seq_id, t, i, x, psi) as (
 select s.seq_id, 0, q.i, ln(q.p) + ln(e.p), -1 from s, {pi} q, {b} e where s.t = 0 and e.i = q.i and e.k = s.o and q.p > 0 and e.p > 0
 union all
 select s.seq_id, s.t, l.j, max(v.x + ln(l.p)) + any_value(ln(e.p)), arg_max(v.i, (v.x + ln(l.p), v.i)) from v{r} v join {a} l on l.i = v.i and l.p > 0
  join s on s.seq_id = v.seq_id and s.t = v.t + 1 join {b} e on e.i = l.j and e.k = s.o and e.p > 0 group by s.seq_id, s.t, l.j)""",
                f"vm{r} as materialized (select * from v{r})",
                f"""path{r}(seq_id, t, q, x) as (
 select seq_id, t, arg_max(i, (x, -i)), max(x) from vm{r} join last using (seq_id, t) group by 1, 2
 union all
 select m.seq_id, m.t - 1, m.psi, null from path{r} p join vm{r} m on m.seq_id = p.seq_id and m.t = p.t and m.i = p.q where m.t > 0)""",
                f"p{r} as materialized (select p.seq_id, p.t, p.q, p.x, s.o, lead(p.q) over (partition by p.seq_id order by p.t) nx from path{r} p join s using (seq_id, t))",
                f"ll{r} as materialized (select sum(x) ll from p{r})",
                f"cp{r} as materialized (select q i, count(*)::double v from p{r} where t = 0 group by 1)",
                f"ca{r} as materialized (select q i, nx j, count(*)::double v from p{r} where nx is not null group by 1, 2)",
                f"cb{r} as materialized (select q i, o k, count(*)::double v from p{r} where o < {m.symbols} group by 1, 2)",
            ]
        else:
            parts += [
                f"""f{r}(seq_id, t, i, x) as (
 select s.seq_id, 0, q.i, q.p * e.p from s, {pi} q, {b} e where s.t = 0 and e.i = q.i and e.k = s.o
 union all
 select s.seq_id, s.t, l.j, sum(f.x * l.p) * any_value(e.p) from f{r} f join {a} l on l.i = f.i join s on s.seq_id = f.seq_id and s.t = f.t + 1 join {b} e on e.i = l.j and e.k = s.o group by s.seq_id, s.t, l.j)""",
                f"fm{r} as materialized (select * from f{r})",
                f"e{r} as materialized (select seq_id, ln(sum(x)) ll from fm{r} join last using (seq_id, t) group by 1)",
                f"""g{r}(seq_id, t, i, x) as (
 select last.seq_id, last.t, q.i, 1::double from last, {pi} q
 union all
 select s.seq_id, g.t - 1, l.i, sum(l.p * e.p * g.x) from g{r} g join s on s.seq_id = g.seq_id and s.t = g.t and g.t > 0 join {a} l on l.j = g.i join {b} e on e.i = g.i and e.k = s.o group by s.seq_id, g.t, l.i)""",
                f"gm{r} as materialized (select * from g{r})",
                f"gam{r} as materialized (select f.seq_id, f.t, f.i, f.x * g.x / exp(e.ll) p from fm{r} f join gm{r} g using (seq_id, t, i) join e{r} e using (seq_id))",
                f"ll{r} as materialized (select sum(ll) ll from e{r})",
                f"cp{r} as materialized (select i, sum(p) v from gam{r} where t = 0 group by 1)",
                f"""ca{r} as materialized (select l.i, l.j, sum(f.x * l.p * e.p * g.x / exp(z.ll)) v from fm{r} f join {a} l on l.i = f.i join s on s.seq_id = f.seq_id and s.t = f.t + 1 join {b} e on e.i = l.j and e.k = s.o
 join gm{r} g on g.seq_id = f.seq_id and g.t = f.t + 1 and g.i = l.j join e{r} z on z.seq_id = f.seq_id group by 1, 2)""",
                f"cb{r} as materialized (select g.i, s.o k, sum(g.p) v from gam{r} g join s using (seq_id, t) where s.o < {m.symbols} group by 1, 2)",
            ]
        new = "case when {t} > 0 then coalesce(c.v, 0) / {t} else o.p end"
        parts += [
            f"pi{r + 1}(i, p) as materialized (select o.i, {new.format(t='sum(c.v) over ()')} from {pi} o left join cp{r} c using (i))",
            f"a{r + 1}(i, j, p) as materialized (select o.i, o.j, {new.format(t='sum(c.v) over (partition by o.i)')} from {a} o left join ca{r} c using (i, j))",
            f"b{r + 1}(i, k, p) as materialized (select o.i, o.k, {new.format(t='sum(c.v) over (partition by o.i)')} from {b} o left join cb{r} c using (i, k) where o.k < {m.symbols} union all select i, k, p from {b} where k = {m.symbols})",
        ]
    parts.append("h as materialized (" + " union all ".join(f"select {r} r, ll from ll{r}" for r in range(rounds)) + ")")
    parts.append(f"stop as materialized (select min(r) r from (select r, ll - lag(ll) over (order by r) d from h) where abs(d) <= 1e-4 * (select count(*) from s where o < {m.symbols}))")
    return ", ".join(parts)


def history(hard: bool, rounds: int) -> str:
    return f"{training(ORDERS, MODEL, hard, rounds)} select 0 run, r iteration, round(ll, 3) ll from h where r <= (select r from stop)"


def cross_validation(folds: int, rounds: int) -> str:
    parts = []
    for k in range(folds):
        chosen = ", ".join(
            f"{t} as materialized (" + " union all ".join(f"select * from {t}{r + 1} where (select r from stop) = {r}" for r in range(rounds)) + ")" for t in ("pi", "a", "b")
        )
        own = f"select * from ({ORDERS}) where seq_id % {folds} = {k}"
        parts.append(f"""select * from ({training(f'select * from ({ORDERS}) where seq_id % {folds} <> {k}', MODEL, False, rounds)}, {chosen},
own as materialized ({own}), f(seq_id, t, i, x) as (
 select own.seq_id, 0, pi.i, pi.p * b.p from own, pi, b where own.t = 0 and b.i = pi.i and b.k = own.o
 union all
 select own.seq_id, own.t, a.j, sum(f.x * a.p) * any_value(b.p) from f join a on a.i = f.i join own on own.seq_id = f.seq_id and own.t = f.t + 1 join b on b.i = a.j and b.k = own.o group by own.seq_id, own.t, a.j),
z as (select f.seq_id, ln(sum(x)) ll from f join (select seq_id, max(t) t from own group by 1) using (seq_id, t) group by 1)
select {k} fold, (select round(sum(ll), 3) from z) ll, (select count(*) from own where o < 5) n_known)""")
    return " union all ".join(parts)


def hit_rows(models: list[HiddenModel]) -> str:
    """``seq_id, hit``: sequences with more than three symbols in a site under any of the models."""
    view = f"select seq_id, i::int t, substr(digits, i + 1, 1)::int o from (select seq_id, digits, unnest(range(length(digits))) i from ({INPUTS}) where digits is not null and path is not null)"
    each = [f"select * from ({viterbi(view, m)} select seq_id, count(*) filter (q <> 0) > 3 hit from path group by 1)" for m in models]
    return f"select seq_id, bool_or(hit) hit from ({' union all '.join(each)}) group by 1"


def hits_against_truth(models: list[HiddenModel]) -> str:
    return f"""select i.seq_id, coalesce(i.fragment, '(none)') fragment, len(list_filter(i.path, lambda x: x > 0)) > 0 truth, coalesce(h.hit, false) hit
 from ({INPUTS}) i left join ({hit_rows(models)}) h on h.seq_id = i.seq_id where i.digits is not null and i.path is not null"""


def swept(p: float) -> HiddenModel:
    model = SWEPT.model(ROWS)
    SWEPT.set_p_binding(model, p)
    return model


def text(q: str) -> str:
    return f"string_agg({q}::varchar, '' order by t)"


def oracle_sql() -> dict[str, str]:
    strand_path = viterbi(DNA, MOTIF)
    sql = {
        "fasta_stripped": f"select seq_id, regexp_replace(seq, '^[nN]+|[nN]+$', '', 'g') seq from ({FASTA})",
        "fasta_wrapped": rf"select md5('>sequence ' || seq_id || chr(10) || regexp_replace(regexp_replace(seq, '(.{{80}})', '\1' || chr(10), 'g'), '\n$', '')) record from ({FASTA}) where length(seq) > 0",
        "encode_known_counts": f"select fragment, coalesce(sum(length(digits)), 0)::bigint n_bases, coalesce(sum(length(replace(digits, '4', ''))), 0)::bigint n_known from ({FASTA}) group by 1",
        "decoded_letters": f"select seq_id, translate(digits, '01234', 'acgtn') seq from ({FASTA})",
        "rev_comp_text": f"select seq_id, reverse(translate(digits, '0123', '3210')) digits from ({FASTA})",
        "complement_counts": f"select case when o = 4 then 4 else 3 - o end sym, count(*) n from ({DNA}) group by 1",
        "masked_sequences": f"select seq_id, {text(f'''(case when {U.format(SEED, 'seq_id::varchar, t::varchar')} < 0.02 then 5 else o end)''')} obs from ({EVENTS}) group by 1",
        "sigmoid_values": "select event_id, round(1 / (1 + exp(-x)), 6) y, abs(ln(y0) - ln(1 - y0) - x) <= 1e-6 is_close from (select event_id, (value - 50) / 10 x, 1 / (1 + exp(-(value - 50) / 10)) y0 from events where value is not null)",
        "log_factorials": "select distinct total, round(case when total <= 1 then 0 else lgamma(total + 1) end, 6) log_factorial from mer_count where total >= 0",
        "distribution_strings": f"""with p as (select pos, sum(p) filter (sym = 0) a, sum(p) filter (sym = 1) c, sum(p) filter (sym = 2) g from ({FREQ}) group by 1)
            select i, string_agg(case when i < 50 * coalesce(a, 0) then 'a' when i < 50 * (coalesce(a, 0) + coalesce(c, 0)) then 'c' when i < 50 * (coalesce(a, 0) + coalesce(c, 0) + coalesce(g, 0)) then 'g' else 't' end, '' order by pos) seq from p, range(50) x(i) group by 1""",
        "distribution_strings_all": f"""with p as (select pos, sum(p) filter (sym = 0) a, sum(p) filter (sym = 1) c, sum(p) filter (sym = 2) g from ({FREQ_ALL}) group by 1)
            select i, string_agg(case when i < 50 * coalesce(a, 0) then 'a' when i < 50 * (coalesce(a, 0) + coalesce(c, 0)) then 'c' when i < 50 * (coalesce(a, 0) + coalesce(c, 0) + coalesce(g, 0)) then 'g' else 't' end, '' order by pos) seq from p, range(50) x(i) group by 1""",
        "order2_codes": f"""with e as ({EVENTS}), c as (select seq_id, t, case when greatest(o, lag(o) over w, lag(o, 2) over w) < 5 and t >= 2 then o + 5 * lag(o) over w + 25 * lag(o, 2) over w else 125 end code from e window w as (partition by seq_id order by t))
            select seq_id, t, code, case when code = 125 then 5 else code % 5 end symbol, case when code = 125 then 25 else code // 5 end previous, case when code = 125 then 25 else code % 25 end following from c""",
        "order_roundtrip": f"select seq_id, true valid, bool_and(o <= 5) valid_symbols, count(*) filter (t >= 2 and o < 5 and o1 < 5 and o2 < 5) n_known, 0 n_wrong from (select *, lag(o) over w o1, lag(o, 2) over w o2 from ({EVENTS}) window w as (partition by seq_id order by t)) group by 1",
        "window_codes": f"""with w as (select seq_id, t - 2 start, o c, lag(o) over v b, lag(o, 2) over v a from ({EVENTS}) window v as (partition by seq_id order by t))
            select seq_id, start, case when greatest(a, b, c) >= 5 then 125 else 25 * a + 5 * b + c end code, case when greatest(a, b, c) >= 5 then '555' else concat(a, b, c) end symbols from w where start >= 0""",
        "window_codes_all": f"""with w as (select seq_id, t - 2 start, o c, lag(o) over v b, lag(o, 2) over v a from ({ORDERS}) window v as (partition by seq_id order by t))
            select seq_id, start, case when greatest(a, b, c) >= 5 then 125 else 25 * a + 5 * b + c end code, case when greatest(a, b, c) >= 5 then '555' else concat(a, b, c) end symbols from w where start >= 0""",
        "chain_counts": f"with {CHAIN} select ord, ctx, sym, cnt from tab",
        "chain_probs": f"with {CHAIN} select ord, ctx, sym, round(p, 6) p, round(logp, 6) logp from pr",
        "chain_lower_order": f"with {CHAIN} select ctx, sym, round(p, 6) p from pr where ord = 1",
        "chain_eval": f"with {EVAL} select seq_id, round(sum(logp), 6) value from e group by 1",
        "chain_eval_cumulative": f"with {EVAL} select seq_id, t, round(sum(logp) over (partition by seq_id order by t), 6) cumulative from e",
        "chain_eval_context": f"with {CHAIN} select w.seq_id, w.t, round(pr.logp, 6) value from w join pr on pr.ord = least(w.t - 4, 2) and pr.code = case least(w.t - 4, 2) when 1 then o1 * 5 + o else o2 * 25 + o1 * 5 + o end where w.t >= 5",
        "kmer_counts": f"select mer, count(*) total from ({mers(6)}) group by 1",
        "kmer_seq_counts": f"select mer, count(*) total, count(distinct seq_id) num_seqs from ({mers(6)}) group by 1",
        "kmer_revcomp_counts": REVCOMP,
        "kmer_top_by_sequences": f"select * from ({REVCOMP}) order by num_seqs desc, total desc, mer limit 10",
        "kmer_most_common": f"select mer, count(*) total from ({mers(6)}) where not contains(mer, '4') group by 1 order by 2 desc, 1 limit 5",
        "kmer_significance": f"""with c as (select {ONE} mer, count(*) c from ({mers(5)}) where not contains(mer, '4') group by 1), t as (select *, sum(c) over () n from c)
            select mer, c total, round(lgamma(n + 1) - lgamma(c + 1) - lgamma(n - c + 1) + c * 5 * ln(0.25) + (n - c) * ln(1 - exp(5 * ln(0.25))), 6) logp from t""",
        "consensus_codes": f"""select code, n, bit_count(code) size, members from (select code::int code, count(*) n from ({ORDERS}) s, range(32) c(code) where o < 5 and (code >> o) & 1 = 1 group by 1)
            join (select code::int code2, string_agg(x::varchar, '' order by x) members from range(32) c(code), range(5) y(x) where (code >> x) & 1 = 1 group by 1) on code = code2""",
        "consensus_of_customers": f"select seq_id, bit_or(1 << o)::int code from ({ORDERS}) where o < 5 group by 1",
        "consensus_words": f"""with w as (select o x, lead(o) over (partition by seq_id order by t) y from ({DNA})), c as (select x, y, count(*) n from w where x < 4 and y < 4 group by all)
            select a::int c1, b::int c2, sum(n)::bigint n from c, range(16) p(a), range(16) q(b) where (a >> x) & 1 = 1 and (b >> y) & 1 = 1 group by 1, 2""",
        "pssm_scores": f"select seq_id, start, round(score, 6) score from ({windows(SCORES, len(ROWS))})",
        "pssm_both_strands": f"""with f as (select seq_id, max(score) x from ({windows(SCORES, len(ROWS))}) group by 1), r as (select seq_id, max(score) y from ({windows(other_strand(SCORES, len(ROWS)), len(ROWS))}) group by 1)
            select i.seq_id, round(x, 6) forward, round(y, 6) reverse, round(greatest(x, y), 6) best from ({FASTA}) i left join f on f.seq_id = i.seq_id left join r on r.seq_id = i.seq_id where i.digits is not null""",
        "pssm_start_value": start_value(),
        "information_content": f"select pos, round(sum(p * (ln(p) - ln(0.25))), 6) nats from ({FREQ}) group by 1",
        "logo_heights": f"select pos, sym, round(p * (2 + sum(p * log2(p)) over (partition by pos)), 6) height from ({FREQ})",
        "information_content_all": f"select pos, round(sum(p * (ln(p) - ln(0.25))), 6) nats from ({FREQ_ALL}) group by 1",
        "logo_heights_all": f"select pos, sym, round(p * (2 + sum(p * log2(p)) over (partition by pos)), 6) height from ({FREQ_ALL})",
        "emission_entropy": f"select fragment, state, round(-sum(p * ln(p)), 6) + 0 nats from ({EMIT}) group by 1, 2",
        "informative_states": f"select fragment, state, round(2 + sum(p * log2(p)), 6) bits from ({EMIT}) group by 1, 2 having 2 + sum(p * log2(p)) > 0.5",
        "forward_loglik": f"{forward(EVENTS, MODEL)} select seq_id, round(ll, 6) ll from ll",
        "forward_loglik_orders": f"{forward(ORDERS, MODEL)} select seq_id, round(ll, 6) ll from ll",
        "backward_loglik": f"{forward(EVENTS, MODEL)}, {backward(MODEL)} select g.seq_id, round(ln(sum(pi.p * b.p * g.x)), 6) ll from g join pi on pi.i = g.i join s on s.seq_id = g.seq_id and s.t = 0 join b on b.i = g.i and b.k = s.o where g.t = 0 group by 1",
        "trellis_consistency": f"{forward(EVENTS, MODEL)}, {backward(MODEL)} select seq_id, bool_and(abs(x - 1) <= 1e-6) ok from (select f.seq_id, f.t, sum(f.x * g.x) / any_value(exp(ll.ll)) x from f join g using (seq_id, t, i) join ll using (seq_id) group by 1, 2) group by 1",
        "total_loglik": f"{forward(EVENTS, MODEL)} select round(sum(ll), 4) ll, (select count(*) from s where o < 5) n_known, round(sum(ll) / (select count(*) from s where o < 5), 6) ll_per_known from ll",
        "posterior_gamma": f"{forward(ORDERS, MODEL)}, {backward(MODEL)} select f.seq_id, f.t, f.i, round(f.x * g.x / exp(ll.ll), 6) gamma from f join g using (seq_id, t, i) join ll using (seq_id)",
        "viterbi_paths": f"{viterbi(ORDERS, MODEL)} select seq_id, round(log_p, 6) log_p, path from fin join (select seq_id, {text('q')} path from path group by 1) using (seq_id)",
        "binding_indicators": f"{viterbi(EVENTS, MODEL)} select seq_id, {text('(q <> 0)::int')} pred from path group by 1",
        "sampled_sequences": sampled(),
        "bw_estep": f"{em(False)} select part, cell, round(value, 4) as value from cells",
        "bw_iteration": f"{em(False)} select cell // 5 i, cell % 5 k, round(value / sum(value) over (partition by cell // 5), 6) p from cells where part = 'b'",
        "viterbi_counts": f"{em(True)} select part, cell, round(value, 4) as value from cells",
        "site_islands": ISLANDS,
        "site_texts": f"""with i as ({ISLANDS}), s as ({STATES}) select i.seq_id, i.start, coalesce(string_agg(s.o::varchar, '' order by s.t), '') site, string_agg(s.q::varchar, ' ' order by s.t) states from i join s on s.seq_id = i.seq_id and s.t >= i.start and s.t < i."end" group by 1, 2""",
        "site_files": f"""with i as ({ISLANDS}), s as ({STATES}) select coalesce(translate(string_agg(s.o::varchar, '' order by s.t), '01234', 'acgtn'), '') site, i.seq_id, i.start, 0 is_rev_comp, string_agg(s.q::varchar, ' ' order by s.t) states from i join s on s.seq_id = i.seq_id and s.t >= i.start and s.t < i."end" group by i.seq_id, i.start""",
        "site_strands": f"""{strand_path}, k as (select path.seq_id, path.t, path.q, s.o from path join s using (seq_id, t)), i as ({islands('select * from k', 'q <> 0')}),
            j as (select i.seq_id, i.start, i."end", {text('k.o')} fwd, string_agg((case when k.o > 3 then k.o else 3 - k.o end)::varchar, '' order by t desc) rev, arg_min(k.q, k.t) q0 from i join k on k.seq_id = i.seq_id and k.t >= i.start and k.t < i."end" group by 1, 2, 3)
            select seq_id, start, "end", case when q0 >= 7 then rev else fwd end site, q0 >= 7 is_rev_comp from j""",
        "masked_sites": f"""with d as (select seq_id, k, i::int t, substr(digits, i + 1, 1)::int o, path[i + 1] q from (select *, unnest(range(length(digits))) i from ({INPUTS}) where digits is not null))
            select i.seq_id, coalesce(x.obs, '') obs from ({INPUTS}) i left join (select seq_id, {text('(case when q >= 1 and (k is null or q <= 2 * k) then 4 else o end)')} obs from d group by 1) x using (seq_id) where i.digits is not null""",
        "mask_counts": f"select count(*) filter (q = 1 or q = 2 * k) n_sites, count(*) filter (q >= 1 and (k is null or q <= 2 * k)) n_symbols from (select s.*, i.k from ({STATES}) s join ({INPUTS}) i using (seq_id))",
        "path_edges": f"""with p as (select fragment, q src, lead(q) over (partition by seq_id order by t) dst from ({STATES}) where fragment is not null)
            select fragment, src, dst, round(count(*) / sum(count(*)) over (partition by fragment, src), 6) p from p where src is not null and dst is not null group by 1, 2, 3""",
        "site_overlaps": OVERLAP,
        "site_roc": f"""with t as ({GIVEN_SITES}), p as ({ISLANDS}), h as (select * from ({OVERLAP}) where o_end - o_start >= 0.25 * (a_end - a_start))
            select (select count(*) from (select distinct seq_id, a_start, a_end from h)) tp, 0::bigint tn,
            (select count(*) from p where (seq_id, start, "end") not in (select (seq_id, b_start, b_end) from h)) fp,
            (select count(*) from t where (seq_id, start, "end") not in (select (seq_id, a_start, a_end) from h)) fn""",
        "base_roc": f"{viterbi(EVENTS, MODEL)} select {CONFUSION.format('(s.o = 1)', '(path.q <> 0)')} from path join s using (seq_id, t)",
        "hits_by_fragment": f"select fragment, {CONFUSION.format('truth', 'hit')} from ({hits_against_truth([MOTIF])}) group by rollup (fragment)",
        "hits_by_models": f"select fragment, {CONFUSION.format('truth', 'hit')} from ({hits_against_truth([MOTIF, OTHER])}) group by rollup (fragment)",
        "roc_sweep": " union all ".join(f"select round({p!r}::double, 6) p, {CONFUSION.format('truth', 'hit')} from ({hits_against_truth([swept(p)])})" for p in SWEEP),
        "motif_loglik": f"{forward_scaled(DNA, MOTIF)} select i.seq_id, round(coalesce(ll, 0), 6) ll from ({FASTA}) i left join ll using (seq_id) where i.digits is not null",
        "motif_total_loglik": f"{forward_scaled(DNA, MOTIF)} select round(sum(ll), 4) ll, (select count(*) from s where o < 4) n_known, round(sum(ll) / (select count(*) from s where o < 4), 6) ll_per_known from ll",
        "trained_history": history(False, 20),
        "viterbi_training": history(True, 14),
        "kfold_loglik": cross_validation(3, 32),
        "fasta_roundtrip": f"select seq_id ord, seq from ({FASTA}) where length(seq) > 0",
        "indicator_runs": islands(EVENTS, "o = 1"),
        "indicator_texts": f"""with i as ({islands(DNA, 'o in (0, 4)')}) select i.seq_id, i.start, i."end", {text('d.o')} site from i join ({DNA}) d on d.seq_id = i.seq_id and d.t >= i.start and d.t < i."end" group by 1, 2, 3""",
        "blanked_sites": f"{strand_path} select i.seq_id, coalesce(x.obs, '') obs from ({FASTA}) i left join (select path.seq_id, string_agg((case when path.q <> 0 then 4 else s.o end)::varchar, '' order by path.t) obs from path join s using (seq_id, t) group by 1) x using (seq_id) where i.digits is not null",
        "fragment_summary": f"select fragment, count(*) n_seqs, coalesce(sum(length(digits)), 0)::bigint n_bases, coalesce(sum(length(replace(digits, '4', ''))), 0)::bigint n_known, floor(100 * sum(length(replace(digits, '4', ''))) / nullif(sum(length(digits)), 0))::bigint percent from ({INPUTS}) group by 1",
        "dataset_sequences": f"select fragment, seq_id, digits from ({INPUTS}) where fragment is not null and digits is not null and train is not null union all select fragment, seq_id, digits from ({INPUTS}) where fragment is not null and digits is not null and test is not null",
        "matched_negatives": f"select p.seq_id ord, case when length(n.digits) >= length(p.digits) then left(n.digits, length(p.digits)::int) end seq from ({INPUTS}) p left join ({FASTA}) n on n.seq_id = p.seq_id where p.digits is not null",
        "paired_negatives": f"""with p as (select seq_id, length(digits) n, row_number() over (order by length(digits) desc, seq_id) - 1 r from ({INPUTS}) where digits is not null),
            f as (select digits, length(digits) n, row_number() over (order by length(digits) desc, seq_id) - 1 r from ({FASTA}) where digits is not null),
            c as (select any_value(p.seq_id) seq_id, p.r, any_value(p.n) n, count(f.r) c from p left join f on f.n >= p.n group by p.r)
            select c.seq_id ord, left(f.digits, c.n::int) seq from c left join f on f.r = case when c.c > 0 then c.r % c.c end""",
        "ranked_fragments": f"""with i as (select fragment, greatest(avg(bits), 0) info from (select fragment, state, 2 + sum(p * log2(p)) bits from ({EMIT}) where state > 0 group by 1, 2) group by 1),
            k as (select fragment, sum(length(replace(digits, '4', ''))) / sum(length(digits)) known from ({INPUTS}) group by 1) select i.fragment, round(sqrt(info * known), 6) score from i join k using (fragment)""",
    }
    best = f"select seq_id, arg_max(start, (score, -start)) start, max(score) score from ({windows(SCORES, len(ROWS))}) group by 1"
    sql["pssm_max"] = f"select i.seq_id, round(b.score, 6) score, coalesce(b.start, -1) start from ({FASTA}) i left join ({best}) b on b.seq_id = i.seq_id where i.digits is not null"
    sql["pssm_background"] = f"""with d as ({DNA}), c as (select o, ln((count(*) + 1.0) / (sum(count(*)) over () + 5)) l from d group by 1), w as ({windows(SCORES, len(ROWS))}),
        cum as (select d.seq_id, d.t, sum(c.l) over (partition by d.seq_id order by d.t) s, c.l from d join c on c.o = d.o),
        b as (select a.seq_id, a.t start, z.s - a.s + a.l bg from cum a join cum z on z.seq_id = a.seq_id and z.t = a.t + 5)
        select i.seq_id, round(max(w.score - b.bg), 6) score from ({FASTA}) i left join w on w.seq_id = i.seq_id left join b on b.seq_id = w.seq_id and b.start = w.start where i.digits is not null group by 1"""
    sql["motif_loglik_backward"] = sql["motif_loglik"]
    sql["roc_file"] = sql["roc_sweep"]
    sql["site_file_roundtrip"] = sql["site_files"].replace("'') site, i.seq_id", "'') site0, i.seq_id").join(("select nullif(site0, '') site, seq_id, start, is_rev_comp, states from (", ")"))
    return sql
