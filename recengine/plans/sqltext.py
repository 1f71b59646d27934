"""Common table expressions of the oracle texts, by name; ``text`` puts those that a query needs before it."""

from __future__ import annotations

_PARTS: dict[str, tuple[str, str]] = {
    # name: (names that it needs, expression)
    "ev": ("", """SELECT user_id, lpad(json_extract_string(props, '$.k'), 3, '0') AS track_id, ts AS "timestamp" FROM events"""),
    "li": ("", """SELECT o_custkey AS user_id, lpad(l_partkey::VARCHAR, 8, '0') AS track_id, o_orderdate AS "timestamp" FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "sp": ("ev", """SELECT ev.*, CASE WHEN "timestamp" <= m - INTERVAL 12 DAY THEN 'retrieval_train' WHEN "timestamp" <= m - INTERVAL 6 DAY THEN 'ranker_train'
        WHEN "timestamp" <= m - INTERVAL 3 DAY THEN 'val' ELSE 'test' END AS split FROM ev, (SELECT max("timestamp") AS m FROM ev)"""),
    "tr": ("sp", "SELECT * FROM sp WHERE split IN ('retrieval_train', 'ranker_train')"),
    "seen": ("tr", "SELECT DISTINCT user_id, track_id FROM tr"),
    "cat": ("tr", "SELECT DISTINCT track_id FROM tr"),
    "rel": ("sp seen", "SELECT DISTINCT user_id, track_id FROM sp WHERE split = 'val' EXCEPT SELECT * FROM seen"),
    "nrel": ("rel", "SELECT user_id, count(*) AS n_rel FROM rel GROUP BY 1"),
    "pop": ("tr", "SELECT track_id, count(DISTINCT user_id)::DOUBLE AS score FROM tr GROUP BY 1"),
    "usr": ("seen", "SELECT DISTINCT user_id FROM seen"),
    "poprecs": ("usr pop seen", """SELECT * FROM (SELECT user_id, track_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, track_id) AS "rank"
        FROM usr, pop WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM seen)) WHERE "rank" <= 10"""),
    "hit": ("poprecs nrel rel", """SELECT p.user_id, p.track_id, p."rank", (r.track_id IS NOT NULL)::INT::DOUBLE AS hit FROM poprecs p JOIN nrel USING (user_id) LEFT JOIN rel r USING (user_id, track_id)"""),
    "ideal": ("", "SELECT m, sum(1 / log2(i + 1)) AS ideal FROM range(1, 101) t(m), range(1, 101) s(i) WHERE i <= m GROUP BY m"),
    "part_": ("", """SELECT lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0') AS track_id, p_name AS title, p_brand AS artist, p_brand || ' / ' || p_type AS album, p_type AS genre, p_size AS "year" FROM part"""),
    "emb": ("", "SELECT lpad(vec_id::VARCHAR, greatest(3, length(vec_id::VARCHAR))::INT, '0') AS track_id, vec_id, embedding::DOUBLE[] AS tt FROM embeddings"),
    "blk": ("emb", """SELECT track_id, tt, tt[1:16] AS als, tt[1:32] AS audio, CASE WHEN vec_id % 7 = 0 THEN list_transform(tt[33:48], lambda x: 0.0::DOUBLE) ELSE tt[33:48] END AS lyrics,
        list_transform(tt[49:64], lambda x: abs(x)) AS genres FROM emb"""),
    "uemb": ("emb", "SELECT track_id, list_transform(tt, lambda x: x / sqrt(list_dot_product(tt, tt))) AS u FROM emb"),
    "usum": ("seen uemb", "SELECT user_id, k, sum(u[k]) AS x FROM seen JOIN uemb USING (track_id), range(1, 65) t(k) GROUP BY 1, 2"),
    "uvec": ("usum", "SELECT user_id, list(x ORDER BY k) AS v0, sqrt(sum(x * x)) AS n FROM usum GROUP BY 1"),
    "user_": ("uvec", "SELECT user_id, list_transform(v0, lambda x: x / n) AS vec FROM uvec"),
    "tops": ("user_ emb seen", """SELECT * FROM (SELECT user_id, track_id, list_dot_product(vec, tt) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(list_dot_product(vec, tt), 9) DESC, track_id) AS "rank"
        FROM user_, emb WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM seen)) WHERE "rank" <= 20"""),
    "lst": ("tr", "SELECT track_id, count(DISTINCT user_id) AS listeners FROM tr GROUP BY 1"),
    "grp": ("lst", """SELECT track_id, CASE least(floor(3 * (sum(listeners) OVER (ORDER BY listeners DESC, track_id ROWS UNBOUNDED PRECEDING) - listeners) / sum(listeners) OVER ()), 2)
        WHEN 0 THEN 'head' WHEN 1 THEN 'middle' ELSE 'tail' END AS "group", cume_dist() OVER (ORDER BY listeners) AS pct FROM lst"""),
    "fl": ("tr", """SELECT user_id, track_id, epoch_us(min("timestamp")) AS f, epoch_us(max("timestamp")) AS l, count(*) AS plays FROM tr GROUP BY 1, 2"""),
    "now_": ("tr", """SELECT epoch_us(max("timestamp")) AS now FROM tr"""),
    "tstat": ("fl now_", """SELECT track_id, count(*) AS n, count(*) FILTER (l > now - 28 * 86400000000) AS r, count(*) FILTER (l > now - 7 * 86400000000) AS s, count(*) FILTER (f > now - 28 * 86400000000) AS fr
        FROM fl, now_ GROUP BY 1"""),
}


def text(needs: str, body: str) -> str:
    """``body`` after the expressions named in ``needs`` and all that those need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in _PARTS[name][0].split():
                add(x)
            order.append(name)

    for n in needs.split():
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in order) + "\n" if order else "") + body
