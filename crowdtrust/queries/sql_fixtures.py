"""DuckDB SQL text for the fixture tables and the unrolled EM oracle.

These strings are the *oracle* side of the correctness check: the same
fixture rows and the same EM maths written as plain SQL over the
pre-registered testdata views, with EM unrolled into K CTE steps.
"""

from __future__ import annotations

# Fixed values shared with crowdtrust.sources.fixtures.
H = "(('0x'||substr(md5({x}),1,8))::BIGINT)"


def h(x: str) -> str:
    return H.format(x=x)


def band(col: str) -> str:
    return (f"(CASE WHEN {col} % 10 <= 1 THEN 0.95e0 WHEN {col} % 10 <= 6 THEN 0.75e0 "
            f"WHEN {col} % 10 <= 8 THEN 0.50e0 ELSE 0.10e0 END)")


VOTES = f"""votes AS (
  SELECT l_orderkey::BIGINT AS prompt_id, l_suppkey::BIGINT AS annotator_id,
         (CASE WHEN {h("concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_suppkey::VARCHAR)")} / 4294967296e0
                    < {band('l_suppkey')}
               THEN t ELSE 1 - t END)::INT AS vote
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey,
               ({h("'truth|' || l_orderkey::VARCHAR")} % 2)::INT AS t FROM lineitem) li
)"""

TRUTH = f"""truth AS (
  SELECT o_orderkey::BIGINT AS prompt_id, ({h("'truth|' || o_orderkey::VARCHAR")} % 2)::INT AS truth_is_a
  FROM orders
)"""

WORKER_TRUTH = f"""worker_truth AS (
  SELECT s_suppkey::BIGINT AS annotator_id, {band('s_suppkey')}::DOUBLE AS true_acc FROM supplier
)"""

COMPACT = """v AS (
  SELECT prompt_id, annotator_id, vote, count(*)::BIGINT AS n FROM votes GROUP BY prompt_id, annotator_id, vote
)"""

LOGPS = f"""logps AS (
  SELECT o_orderkey::BIGINT AS prompt_id,
         -200e0 + 150e0 * {h("'pi_a|' || o_orderkey::VARCHAR")} / 4294967296e0 AS pi_a,
         -200e0 + 150e0 * {h("'pi_b|' || o_orderkey::VARCHAR")} / 4294967296e0 AS pi_b,
         -200e0 + 150e0 * {h("'ref_a|' || o_orderkey::VARCHAR")} / 4294967296e0 AS ref_a,
         -200e0 + 150e0 * {h("'ref_b|' || o_orderkey::VARCHAR")} / 4294967296e0 AS ref_b
  FROM orders
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def posterior(la: str, lb: str) -> str:
    m = f"greatest({la}, {lb})"
    return f"(exp(({la}) - {m}) / (exp(({la}) - {m}) + exp(({lb}) - {m})))"


def clip(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def onecoin_ctes(k: int, votes_cte: str = "v", prior_cte: str | None = None, p: str = "") -> list[str]:
    """{p}a0..{p}ak (alpha per annotator) and {p}g1..{p}gk (gamma per prompt)."""
    ctes = [f"{p}a0 AS MATERIALIZED (SELECT DISTINCT annotator_id, 0.6e0 AS alpha FROM {votes_cte})"]
    for i in range(1, k + 1):
        ctes += onecoin_step(f"{p}a{i-1}", f"{p}s{i}", f"{p}g{i}", f"{p}a{i}", votes_cte, prior_cte)
    return ctes


def onecoin_step(before: str, s: str, g: str, a: str, votes_cte: str, prior_cte: str | None = None) -> list[str]:
    """One E-step with the accuracies ``before`` (sums ``s``, posteriors ``g``) and the M-step ``a``."""
    if prior_cte:
        pa = f"ln({clip('coalesce(pr.prior, 0.5e0)', '1e-9', '1 - 1e-9')})"
        pb = f"ln(1 - {clip('coalesce(pr.prior, 0.5e0)', '1e-9', '1 - 1e-9')})"
        src = f"{s} LEFT JOIN {prior_cte} pr USING (prompt_id)"
    else:
        pa = pb = "ln(0.5e0)"
        src = s
    return [f"""{s} AS MATERIALIZED (
  SELECT vv.prompt_id,
         sum(n * CASE WHEN vote = 1 THEN ln(alpha) ELSE ln(1 - alpha) END) AS sa,
         sum(n * CASE WHEN vote = 1 THEN ln(1 - alpha) ELSE ln(alpha) END) AS sb
  FROM {votes_cte} vv JOIN {before} USING (annotator_id) GROUP BY vv.prompt_id)""",
            f"{g} AS MATERIALIZED (SELECT prompt_id, {posterior(f'{pa} + sa', f'{pb} + sb')} AS g FROM {src})",
            f"""{a} AS MATERIALIZED (
  SELECT annotator_id,
         {clip('sum(n * CASE WHEN vote = 1 THEN g ELSE 1 - g END) / greatest(sum(n)::DOUBLE, 1e0)', '1e-4', '1 - 1e-4')} AS alpha
  FROM {votes_cte} vv JOIN {g} USING (prompt_id) GROUP BY annotator_id)"""]


def twocoin_ctes(k: int, legacy: bool = False, votes_cte: str = "v") -> list[str]:
    ctes = [f"a0 AS MATERIALIZED (SELECT DISTINCT annotator_id, 0.7e0 AS alpha, 0.7e0 AS beta FROM {votes_cte})",
            "p0 AS MATERIALIZED (SELECT 0.5e0 AS pi1)"]
    for i in range(1, k + 1):
        pic = clip("pi1", "1e-9", "1 - 1e-9")
        if legacy:
            pa = f"ln(pi1 + 1e-9) + ln({pic})"
            pb = f"ln(1 - pi1 + 1e-9) + ln(1 - {pic})"
        else:
            pa, pb = f"ln({pic})", f"ln(1 - {pic})"
        ctes.append(f"""s{i} AS MATERIALIZED (
  SELECT vv.prompt_id,
         sum(n * CASE WHEN vote = 1 THEN ln(alpha) ELSE ln(1 - alpha) END) AS sa,
         sum(n * CASE WHEN vote = 1 THEN ln(1 - beta) ELSE ln(beta) END) AS sb
  FROM {votes_cte} vv JOIN a{i-1} USING (annotator_id) GROUP BY vv.prompt_id)""")
        ctes.append(f"g{i} AS MATERIALIZED (SELECT prompt_id, {posterior(f'{pa} + sa', f'{pb} + sb')} AS g FROM s{i}, p{i-1})")
        ctes.append(f"p{i} AS MATERIALIZED (SELECT avg(g) AS pi1 FROM g{i})")
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT annotator_id,
         {clip('sum(CASE WHEN vote = 1 THEN n * g ELSE 0e0 END) / (sum(n * g) + 1e-6)', '1e-6', '1 - 1e-6')} AS alpha,
         {clip('sum(CASE WHEN vote = 0 THEN n * (1 - g) ELSE 0e0 END) / (sum(n * (1 - g)) + 1e-6)', '1e-6', '1 - 1e-6')} AS beta
  FROM {votes_cte} vv JOIN g{i} USING (prompt_id) GROUP BY annotator_id)""")
    return ctes


def onecoin_history(k: int) -> str:
    rows = []
    for i in range(1, k + 1):
        prev = f"g{i-1}" if i > 1 else None
        shift = (f"(SELECT max(abs(x.g - y.g)) FROM g{i} x JOIN {prev} y USING (prompt_id))" if prev
                 else f"(SELECT max(abs(g - 0.5e0)) FROM g{i})")
        l1 = f"(SELECT avg(abs(true_acc - alpha)) FROM worker_truth JOIN a{i} USING (annotator_id))"
        rows.append(f"SELECT {i} AS iteration, round({l1}, 6) AS l1_parameter_loss, round({shift}, 6) AS max_gamma_shift")
    return "\nUNION ALL\n".join(rows)


def softplus(x: str) -> str:
    return f"(greatest({x}, 0e0) + ln(1 + exp(-abs({x}))))"


LOGIT = "((pi_a - pi_b) - (ref_a - ref_b))"

PAIRS = f"""lab AS (SELECT d.doc_id, d.text, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)),
good AS (SELECT doc_id AS chosen_id, text AS chosen, lang, count(*) OVER (PARTITION BY lang) AS n,
                row_number() OVER (PARTITION BY lang ORDER BY {h("doc_id::VARCHAR")}, doc_id) - 1 AS pos FROM lab WHERE quality = 1),
bad AS (SELECT doc_id AS rejected_id, text AS rejected, lang, count(*) OVER (PARTITION BY lang) AS n,
               row_number() OVER (PARTITION BY lang ORDER BY {h("doc_id::VARCHAR")}, doc_id) - 1 AS pos FROM lab WHERE quality = 0),
nl AS (SELECT g.lang, g.n AS ng, b.n AS nb FROM (SELECT DISTINCT lang, n FROM good) g JOIN (SELECT DISTINCT lang, n FROM bad) b USING (lang)),
slots AS (SELECT lang, ng, nb, unnest(range(greatest(ng, nb))) AS slot FROM nl),
pr AS (SELECT g.chosen_id, b.rejected_id, s.lang, s.slot, g.chosen, b.rejected FROM slots s
       JOIN good g ON g.lang = s.lang AND g.pos = s.slot % s.ng JOIN bad b ON b.lang = s.lang AND b.pos = s.slot % s.nb),
pairs AS (SELECT (row_number() OVER (ORDER BY rejected_id, chosen_id, slot) - 1)::BIGINT AS prompt_id,
                 chosen, rejected, lang, chosen_id::BIGINT AS chosen_id, rejected_id::BIGINT AS rejected_id FROM pr),
prompts AS (SELECT prompt_id, CASE WHEN o = 1 THEN chosen ELSE rejected END AS text_a,
                   CASE WHEN o = 1 THEN rejected ELSE chosen END AS text_b, o AS truth_is_a
            FROM (SELECT *, ({h("'42|orient|' || prompt_id::VARCHAR")} % 2)::INT AS o FROM pairs))"""

PAIR_VOTES = f"""pv AS (
  SELECT prompt_id, annotator_id,
         (CASE WHEN {h("concat_ws('|', prompt_id::VARCHAR, 'v', slot::VARCHAR)")} / 4294967296e0 < {band('annotator_id')}
               THEN truth_is_a ELSE 1 - truth_is_a END)::INT AS vote
  FROM (SELECT prompt_id, truth_is_a, slot,
               ({h("concat_ws('|', prompt_id::VARCHAR, 'a', slot::VARCHAR)")} % 30)::BIGINT AS annotator_id
        FROM prompts, range(0, 3) s(slot)))"""


def tokens_sql(text: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), "
            f"lambda x: length(x) > 0)")


def vocab_cte(vocab_size: int | None) -> str:
    """The most frequent tokens, or all of them."""
    cap = "" if vocab_size is None else f"ORDER BY count DESC, token LIMIT {vocab_size - 2}"
    return f"""dtok AS (SELECT unnest({tokens_sql('text')}) AS token FROM documents),
dcnt AS (SELECT token, count(*)::BIGINT AS count FROM dtok GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY count DESC, token) - 1 + 2)::INT AS token_id, count
          FROM dcnt {cap})"""


SIDE_TOKENS = f"""stok AS (
  SELECT prompt_id, 'a' AS side, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token
  FROM (SELECT prompt_id, {tokens_sql('text_a')} AS t FROM prompts)
  UNION ALL
  SELECT prompt_id, 'b' AS side, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token
  FROM (SELECT prompt_id, {tokens_sql('text_b')} AS t FROM prompts)),
sid AS (SELECT prompt_id, side, pos, coalesce(token_id, 1) AS token_id FROM stok LEFT JOIN vocab USING (token)),
big AS (SELECT x.prompt_id, x.side, x.token_id AS prev_id, y.token_id AS token_id, count(*)::BIGINT AS cnt
        FROM sid x JOIN sid y ON x.prompt_id = y.prompt_id AND x.side = y.side AND y.pos = x.pos + 1
        GROUP BY ALL)"""

RANKS = f"""ranks AS (
  SELECT annotator_id, (row_number() OVER (ORDER BY hh, annotator_id) - 1) AS crowd_rank,
         count(*) OVER () AS n_total
  FROM (SELECT DISTINCT annotator_id, {h("'42|crowd|' || annotator_id::VARCHAR")} AS hh FROM votes))"""


def role_sql(rank: str, crowd: str, adv: str) -> str:
    spam = f"greatest(0e0, 0.40e0 - {adv})"
    return (f"(CASE WHEN {rank} < floor({crowd} * {adv}) THEN 'adversary' "
            f"WHEN {rank} < floor({crowd} * {adv}) + floor({crowd} * {spam}) THEN 'spammer' ELSE 'honest' END)")


_COIN_KEY = "concat_ws('|', '42|coin', prompt_id::VARCHAR, annotator_id::VARCHAR)"
COIN = f"(({h(_COIN_KEY)} / 4294967296e0) < 0.5)::INT"
VOTE_ORDER = h("concat_ws('|', '42|sparse', prompt_id::VARCHAR, annotator_id::VARCHAR, vote::VARCHAR)")


# ---------------------------------------------------------------- the stress sweep
RANKED_VOTES = f"""rk AS MATERIALIZED (
  SELECT v.prompt_id, v.annotator_id, v.vote, crowd_rank, n_total, true_acc,
         row_number() OVER (PARTITION BY v.prompt_id ORDER BY {VOTE_ORDER.replace("prompt_id", "v.prompt_id").replace("annotator_id", "v.annotator_id").replace("vote::", "v.vote::")},
                            v.annotator_id, v.vote) AS r
  FROM votes v JOIN ranks USING (annotator_id) LEFT JOIN worker_truth USING (annotator_id))"""


def config_rows(configs) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        f"({c.config_id}, '{c.variable_tested}', {c.L}, {c.Adv}e0, {c.N})" for c in configs) + ") t(config_id, variable_tested, L, Adv, N)"


def sweep_ctes(p: str, configs_sql: str, k: int) -> list[str]:
    """Perturbed votes and k one-coin iterations of every configuration:
    {p}w workers' votes, {p}t true accuracies, {p}g1.. posteriors, {p}a1.. accuracies, {p}m the matrix."""
    worker = f"((crowd_rank + n_total * ({h("'crowd share|' || prompt_id::VARCHAR")} % ceil(N / n_total::DOUBLE)::BIGINT)) % N)"
    role = role_sql("worker", "N::DOUBLE", "Adv")
    ctes = [f"{p}c AS MATERIALIZED ({configs_sql})",
            f"""{p}x AS (SELECT config_id, prompt_id, annotator_id, vote, true_acc, worker, {role} AS role
  FROM (SELECT *, {worker} AS worker FROM rk JOIN {p}c ON r <= L))""",
            f"""{p}w AS MATERIALIZED (
  SELECT config_id, prompt_id, worker::BIGINT AS annotator_id,
         (CASE WHEN role = 'adversary' THEN 1 - vote WHEN role = 'spammer' THEN {COIN} ELSE vote END)::INT AS vote,
         CASE WHEN role = 'adversary' THEN 1 - true_acc WHEN role = 'spammer' THEN 0.5e0 ELSE true_acc END AS true_acc FROM {p}x)""",
            f"{p}t AS MATERIALIZED (SELECT config_id, annotator_id, avg(true_acc) AS true_acc FROM {p}w GROUP BY ALL)",
            f"{p}v AS MATERIALIZED (SELECT config_id, prompt_id, annotator_id, vote, count(*)::BIGINT AS n FROM {p}w GROUP BY ALL)",
            f"{p}a0 AS MATERIALIZED (SELECT DISTINCT config_id, annotator_id, 0.6e0 AS alpha FROM {p}v)"]
    for i in range(1, k + 1):
        ctes.append(f"""{p}s{i} AS MATERIALIZED (
  SELECT config_id, prompt_id, sum(n * CASE WHEN vote = 1 THEN ln(alpha) ELSE ln(1 - alpha) END) AS sa,
         sum(n * CASE WHEN vote = 1 THEN ln(1 - alpha) ELSE ln(alpha) END) AS sb
  FROM {p}v JOIN {p}a{i-1} USING (config_id, annotator_id) GROUP BY ALL)""")
        ctes.append(f"{p}g{i} AS MATERIALIZED (SELECT config_id, prompt_id, {posterior('ln(0.5e0) + sa', 'ln(0.5e0) + sb')} AS g FROM {p}s{i})")
        ctes.append(f"""{p}a{i} AS MATERIALIZED (
  SELECT config_id, annotator_id,
         {clip('sum(n * CASE WHEN vote = 1 THEN g ELSE 1 - g END) / greatest(sum(n)::DOUBLE, 1e0)', '1e-4', '1 - 1e-4')} AS alpha
  FROM {p}v JOIN {p}g{i} USING (config_id, prompt_id) GROUP BY ALL)""")
    ctes.append(f"""{p}m AS MATERIALIZED (SELECT c.config_id, variable_tested, L, Adv, N, Error FROM {p}c c LEFT JOIN (
  SELECT config_id, avg(abs(true_acc - alpha)) AS Error FROM {p}a{k} JOIN {p}t USING (config_id, annotator_id) GROUP BY config_id) USING (config_id))""")
    return ctes


# ---------------------------------------------------------------- one-feature preference models
VOCAB_SIZE = "(SELECT count(*) + 2e0 FROM vocab)"

REF_MODEL = f"""rb AS (SELECT prev_id, token_id, sum(cnt)::DOUBLE AS c FROM big GROUP BY prev_id, token_id),
  rctx AS (SELECT prev_id, sum(c) AS c_prev FROM rb GROUP BY prev_id),
  ref AS MATERIALIZED (SELECT prev_id, token_id, ln((c + 1) / (c_prev + {VOCAB_SIZE})) AS logp, ln(1 / (c_prev + {VOCAB_SIZE})) AS unseen
          FROM rb JOIN rctx USING (prev_id)),
  ctxr AS (SELECT DISTINCT prev_id, unseen FROM ref)"""

NEWTON_STEPS = 15


def newton_ctes(p: str, src: str) -> list[str]:
    """{p}w: the weight w of the regression y ~ sigmoid(w x + o) with case weights wt, without intercept."""
    ctes = [f"{p}w0 AS MATERIALIZED (SELECT 0e0 AS w)"]
    for i in range(1, NEWTON_STEPS + 1):
        ctes.append(f"""{p}w{i} AS MATERIALIZED (SELECT any_value(w) + sum(wt * x * (y - q)) / sum(wt * x * x * q * (1 - q)) AS w
  FROM (SELECT *, 1 / (1 + exp(-(w * x + o))) AS q FROM {src}, {p}w{i-1}))""")
    ctes.append(f"{p}w AS MATERIALIZED (SELECT w FROM {p}w{NEWTON_STEPS})")
    return ctes


def run_metrics_sql(run: str, epoch: int, src: str, w: str) -> str:
    loss = f"(y * {softplus('-(w * x)')} + (1 - y) * {softplus('(w * x)')})"
    return f"""SELECT '{run}' AS run, {epoch} AS epoch, (SELECT sum(wt * {loss}) / sum(wt) FROM {src}, {w}) AS train_loss,
  (SELECT avg((((w * x) / 0.1e0 - o / 0.1e0 > 0)::INT = truth_is_a)::INT) FROM f, {w} WHERE is_test) AS test_accuracy,
  (SELECT avg(((w * x > 0)::INT = truth_is_a)::INT) FROM f, {w} WHERE is_test) AS test_reward_accuracy,
  (SELECT avg(w * x) FROM {src}, {w}) AS reward_margin"""


def one_feature_ctes(k: int, epochs: int) -> list[str]:
    """f (features and offsets of all prompts), static and joint runs, and their metrics ``runs``."""
    ctes = [PAIRS, PAIR_VOTES, vocab_cte(None), SIDE_TOKENS, REF_MODEL, f"""sr AS (
  SELECT b.prompt_id, b.side, sum(b.cnt * coalesce(p.logp, c.unseen, -ln({VOCAB_SIZE}))) / sum(b.cnt) * 10e0 AS lp
  FROM big b LEFT JOIN ref p USING (prev_id, token_id) LEFT JOIN ctxr c USING (prev_id) GROUP BY ALL)""",
            f"""f AS MATERIALIZED (SELECT prompt_id, truth_is_a, (len({tokens_sql('text_a')}) - len({tokens_sql('text_b')}))::DOUBLE / 100e0 AS x,
         -0.1e0 * (coalesce(a.lp, 0) - coalesce(b.lp, 0)) AS o, ({h("'42|split|' || prompt_id::VARCHAR")} / 4294967296e0 < 0.2e0) AS is_test
  FROM prompts LEFT JOIN (SELECT prompt_id, lp FROM sr WHERE side = 'a') a USING (prompt_id)
               LEFT JOIN (SELECT prompt_id, lp FROM sr WHERE side = 'b') b USING (prompt_id))""",
            "pvt AS MATERIALIZED (SELECT pv.* FROM pv JOIN f USING (prompt_id) WHERE NOT is_test)",
            "pvc AS MATERIALIZED (SELECT prompt_id, annotator_id, vote, count(*)::BIGINT AS n FROM pvt GROUP BY ALL)",
            "nv AS MATERIALIZED (SELECT prompt_id, count(*)::DOUBLE AS wt, avg(vote) AS share FROM pvt GROUP BY prompt_id)",
            *onecoin_ctes(k, votes_cte="pvc", p="p"),
            "so AS MATERIALIZED (SELECT f.*, truth_is_a::DOUBLE AS y, 1e0 AS wt FROM f WHERE NOT is_test)",
            "sb AS MATERIALIZED (SELECT f.*, share AS y, wt FROM f JOIN nv USING (prompt_id))",
            f"ss AS MATERIALIZED (SELECT f.*, g AS y, wt FROM f JOIN pg{k} USING (prompt_id) JOIN nv USING (prompt_id))",
            *newton_ctes("o", "so"), *newton_ctes("b", "sb"), *newton_ctes("t", "ss"),
            "ja0 AS MATERIALIZED (SELECT DISTINCT annotator_id, 0.6e0 AS alpha FROM pvc)"]
    runs = [run_metrics_sql("oracle", 1, "so", "ow"), run_metrics_sql("baseline", 1, "sb", "bw"), run_metrics_sql("static_em", 1, "ss", "tw")]
    for e in range(1, epochs + 1):
        if e > 1:
            ctes.append(f"jp{e} AS MATERIALIZED (SELECT prompt_id, 1 / (1 + exp(-(w * x + o))) AS prior FROM f, j{e-1}w)")
        ctes += onecoin_step(f"ja{e-1}", f"js{e}", f"jg{e}", f"ja{e}", "pvc", f"jp{e}" if e > 1 else None)
        ctes.append(f"jx{e} AS MATERIALIZED (SELECT f.*, g AS y, wt FROM f JOIN jg{e} USING (prompt_id) JOIN nv USING (prompt_id))")
        ctes += newton_ctes(f"j{e}", f"jx{e}")
        runs.append(run_metrics_sql("joint", e, f"jx{e}", f"j{e}w"))
    ctes.append("runs AS MATERIALIZED (" + "\n UNION ALL ".join(runs) + ")")
    return ctes
