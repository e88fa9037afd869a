"""The same answers in SQL, worked out from the tables and not from the library: draws and
masks are DuckDB's own digests.

Only the declared constants (ranges, class lists, letters) are shared with the queries.
"""

from __future__ import annotations

from quorum.checks import datasets as sets

BAGS = 3
TREE_DEPTH = 3

# Cumulative Poisson(0.66) probabilities of 0, 1, 2, ... draws.
POISSON_CDF = (
    0.5168513344916992,
    0.8579732152562207,
    0.9705434359085128,
    0.995308884452017,
    0.9993951834616952,
    0.9999345749309727,
    0.9999939079925932,
    0.9999995022526889,
)


def draw(salt: str, key=(), part: int = 0) -> str:
    """32 bits of the digest of salt and key, over 2^32."""
    digest = f"md5(concat_ws('|', {', '.join([f"'{salt}'", *(f'{k}::varchar' for k in key)])}))"
    return f"(('0x' || substr({digest}, {1 + 8 * part}, 8))::bigint / 4294967296.0)"


def bag_weight(bag: int, key) -> str:
    """Poisson draw of a bag; four bags share a digest."""
    u = draw(f"bags{bag // 4}", key, bag % 4)
    return "(" + " + ".join(f"({u} >= {c})::int" for c in POISSON_CDF) + ")::int"


def kept_input(bag: int, j: int) -> str:
    return f"({draw(f'mask|{bag}|{j}')} < 0.85)"


def scaled(x: str, low: float, high: float) -> str:
    return f"(({x} - {float(low)}::double) / {float(high) - float(low)}::double)"


def position(x: str, values) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"(coalesce(list_position([{listed}], {x}), 0) - 1)::double"


def names(prefix: str, n: int) -> str:
    return ", ".join(f"{prefix}{i}" for i in range(n))


def rounded(x: str) -> str:
    return f"round_even({x} * 100, 0) / 100"


LINEITEM_KEY = ", ".join(sets.LINEITEM_KEY)
LINEITEM_FEATURES = ", ".join(
    f"{scaled(a.name, a.range_min, a.range_max)} AS f{j}" for j, a in enumerate(sets.LINEITEM_REALS)
)
PRIORITY = "replace(o_orderpriority, ' ', '_')"


class LabelledSet:
    """The SQL of a labelled set: ``base`` has a row number, the key, f0.., label, part, fold."""

    def __init__(self, source: str, key, features: list[str], label: str, n_classes: int):
        self.key = key
        self.d = len(features)
        self.n_classes = n_classes
        columns = ", ".join(f"{f} AS f{j}" for j, f in enumerate(features))
        self.base = f"""
raw AS (SELECT row_number() OVER () AS rid, {', '.join(key)}, {columns}, * EXCLUDE ({', '.join(key)})
        FROM {source}),
base AS (SELECT rid, {', '.join(key)}, {names('f', self.d)}, {label} AS label,
         CASE WHEN {draw('split', key)} < 0.6 THEN 'train' ELSE 'test' END AS part,
         floor({draw('fold', key)} * 10)::int AS fold
         FROM raw),
train AS (SELECT * FROM base WHERE part = 'train'),
test AS (SELECT * FROM base WHERE part = 'test')"""

    def fit(self, out: str, rows: str, group: str = "0", weight: str = "1", keep=None) -> str:
        """Bayes parameters per group of ``rows``; ``keep[group]`` says which inputs count."""
        sums = ", ".join(f"sum(({weight}) * f{j}) AS r{j}" for j in range(self.d))
        if keep is None:
            masked = ", ".join(f"r{j} AS s{j}" for j in range(self.d))
        else:
            masked = ", ".join(
                "CASE "
                + " ".join(f"WHEN g = {g} THEN CASE WHEN {k[j]} THEN r{j} ELSE 0.0 END" for g, k in keep.items())
                + f" END AS s{j}"
                for j in range(self.d)
            )
        total = " + ".join(f"s{j}" for j in range(self.d))
        theta = ", ".join(f"ln(s{j} + 1) - ln({total} + {self.d}) AS t{j}" for j in range(self.d))
        return f"""
{out}_sums AS (SELECT {group} AS g, label, sum({weight})::double AS n, {sums} FROM {rows} GROUP BY ALL),
{out}_kept AS (SELECT g, label, n, {masked} FROM {out}_sums),
{out} AS (SELECT g, label, ln(n + 1) - ln(sum(n) OVER (PARTITION BY g) + count(*) OVER (PARTITION BY g)) AS pi,
          {theta} FROM {out}_kept)"""

    def guess(self, out: str, rows: str, model: str, on: str = "true") -> str:
        """The first best class of every row of ``rows`` under every matching group of ``model``."""
        score = " + ".join(["m.pi", *[f"m.t{j} * x.f{j}" for j in range(self.d)]])
        return f"""
{out} AS (SELECT x.*, m.g, m.label AS prediction FROM {rows} x JOIN {model} m ON {on}
          QUALIFY row_number() OVER (PARTITION BY x.rid, m.g ORDER BY {score} DESC, m.label) = 1)"""

    def tree(self, out: str, rows: str, depth: int = TREE_DEPTH, weight: str = "1") -> str:
        """A Gini tree per ``g`` of ``rows``: the best cut of every node, level by level, and the
        leaf of every row as ``{out}_leaf``. Candidate cuts lie halfway between neighbouring
        values of the whole sample; of equal ones the first input and the lowest cut wins."""
        classes = range(self.n_classes)
        kc = [f"k{c}" for c in classes]
        parts = [
            f"""
{out}_at0 AS (SELECT *, 1 AS node, ({weight})::double AS w FROM {rows} WHERE ({weight}) > 0),
{out}_value AS ({self._points(f'(SELECT g, {names("f", self.d)} FROM {out}_at0)', 'g')}),
{out}_edge AS (SELECT g, feature, x, lead(x) OVER (PARTITION BY g, feature ORDER BY x) AS next_x
               FROM (SELECT DISTINCT g, feature, x FROM {out}_value))"""
        ]
        squares = lambda p: " + ".join(f"{p}{c} * {p}{c}" for c in classes)
        for level in range(depth):
            at, best = f"{out}_at{level}", f"{out}_best{level}"
            sums = ", ".join(f"sum(w) FILTER (label = {c}) AS k{c}" for c in classes)
            low = ", ".join(f"coalesce(sum(k{c}) FILTER (h.x <= e.x), 0) AS c{c}" for c in classes)
            all_ = ", ".join(f"coalesce(sum(k{c}), 0) AS a{c}" for c in classes)
            cn, an = " + ".join(f"c{c}" for c in classes), " + ".join(f"a{c}" for c in classes)
            high = ", ".join(f"a{c} - c{c} AS d{c}" for c in classes)
            parts.append(f"""
{at}_hist AS (SELECT g, node, feature, x, count(*) AS m, {sums} FROM ({self._points(at, 'g, node, label, w')}) GROUP BY ALL),
{at}_cut AS (SELECT e.g, h.node, e.feature, e.x, e.next_x, coalesce(sum(m) FILTER (h.x <= e.x), 0) AS m, sum(m) AS am, {low}, {all_}
             FROM {out}_edge e JOIN {at}_hist h ON e.g = h.g AND e.feature = h.feature
             WHERE e.next_x IS NOT NULL GROUP BY ALL),
{at}_sides AS (SELECT *, {cn} AS n, {an} AS an, {high} FROM {at}_cut WHERE m > 0 AND m < am),
{at}_rated AS (SELECT *, (n - ({squares('c')}) / n) + ((an - n) - ({squares('d')}) / (an - n)) AS impurity,
               an - ({squares('a')}) / an AS before FROM {at}_sides),
{best} AS (SELECT g, node, feature, (x + next_x) / 2 AS cut FROM {at}_rated WHERE before - impurity > 1e-9
           QUALIFY row_number() OVER (PARTITION BY g, node ORDER BY round(impurity, 6), feature, x) = 1),
{out}_at{level + 1} AS ({self._step(at, best)})""")
        counts = ", ".join(f"coalesce(sum(w) FILTER (label = {c}), 0) AS {k}" for c, k in zip(classes, kc))
        parts.append(f"""
{out}_leaf AS (SELECT g, node, {self.winner(kc)} AS prediction
               FROM (SELECT g, node, {counts} FROM {out}_at{depth} GROUP BY g, node))""")
        return ",".join(parts)

    def _points(self, rows: str, keep: str) -> str:
        return " UNION ALL ".join(f"SELECT {keep}, {j} AS feature, f{j} AS x FROM {rows}" for j in range(self.d))

    def _step(self, rows: str, best: str) -> str:
        x = "CASE b.feature " + " ".join(f"WHEN {j} THEN r.f{j}" for j in range(self.d)) + " END"
        return f"""SELECT r.* EXCLUDE (node), CASE WHEN b.feature IS NULL THEN r.node
ELSE 2 * r.node + ({x} > b.cut)::int END AS node FROM {rows} r LEFT JOIN {best} b ON r.g = b.g AND r.node = b.node"""

    def tree_guess(self, out: str, rows: str, model: str, depth: int = TREE_DEPTH) -> str:
        """The leaf's class for every row of ``rows``, which name the tree in ``g``."""
        parts = [f"\n{out}_0 AS (SELECT *, 1 AS node FROM {rows})"]
        for level in range(depth):
            parts.append(f"\n{out}_{level + 1} AS ({self._step(f'{out}_{level}', f'{model}_best{level}')})")
        parts.append(f"""
{out} AS (SELECT r.* EXCLUDE (node), l.prediction FROM {out}_{depth} r JOIN {model}_leaf l ON r.g = l.g AND r.node = l.node)""")
        return ",".join(parts)

    def single_tree(self) -> str:
        return (
            self.base
            + ","
            + self.tree("tree", "(SELECT 0 AS g, * FROM train)")
            + ","
            + self.tree_guess("scored", "(SELECT 0 AS g, * FROM test)", "tree")
        )

    def bagging_mixed(self) -> str:
        """Bag 0 is Bayes, bag 1 a tree."""
        masked = ", ".join(f"CASE WHEN {kept_input(1, j)} THEN f{j} ELSE 0.0 END AS f{j}" for j in range(self.d))
        counts = ", ".join(f"(p0 = {c})::int + (p1 = {c})::int AS v{c}" for c in range(self.n_classes))
        return (
            self.base
            + f""",
drawn AS (SELECT {bag_weight(0, self.key)} AS w, * FROM train),
bag1 AS (SELECT 0 AS g, rid, {masked}, label, {bag_weight(1, self.key)} AS bw FROM train),"""
            + self.fit("model", "(SELECT * FROM drawn WHERE w > 0)", "0", "w", {0: [kept_input(0, j) for j in range(self.d)]})
            + ","
            + self.guess("by_bayes", "test", "model")
            + ","
            + self.tree("tree", "bag1", weight="bw")
            + ","
            + self.tree_guess("by_tree", "(SELECT 0 AS g, * FROM test)", "tree")
            + f""",
both_ AS (SELECT b.rid, {', '.join('b.' + k for k in self.key)}, b.label, b.prediction AS p0, t.prediction AS p1
          FROM by_bayes b JOIN by_tree t USING (rid)),
scored AS (SELECT *, {self.winner([f'v{c}' for c in range(self.n_classes)])} AS prediction
           FROM (SELECT *, {counts} FROM both_))"""
        )

    def stacking_mixed(self) -> str:
        """Level 0: Bayes and a tree, out of fold; level 1: Bayes on both copies."""
        others = "(SELECT k.k AS g, t.* FROM train t JOIN range(0, 10) k(k) ON t.fold <> k.k)"
        return (
            self.base
            + ","
            + self.fit("level0", others, "g")
            + ","
            + self.guess("by_bayes", "train", "level0", "m.g = x.fold")
            + ","
            + self.tree("tree", others)
            + ","
            + self.tree_guess("by_tree", "(SELECT fold AS g, * FROM train)", "tree")
            + f""",
copies AS (SELECT {names('f', self.d)}, prediction AS label FROM by_bayes
           UNION ALL SELECT {names('f', self.d)}, prediction FROM by_tree),"""
            + self.fit("model", "copies")
            + ","
            + self.guess("scored", "test", "model")
        )

    def logit(self, out: str, rows: str, weight: str = "1", keep=None, steps: int = 12) -> str:
        """Two classes, two inputs, no intercept: the weights ``w0``, ``w1`` of class 1 for every
        ``g`` of ``rows``, by Newton steps over whole sums. ``keep[g]`` says which inputs count."""
        seen = "true" if keep is None else None
        parts = [f"""
{out}_rows AS (SELECT g, label, ({weight})::double AS w, """]
        for j in range(2):
            if seen:
                parts.append(f"f{j} AS x{j}" + (", " if j == 0 else ""))
            else:
                cases = " ".join(f"WHEN {g} THEN CASE WHEN {k[j]} THEN f{j} ELSE 0.0 END" for g, k in keep.items())
                parts.append(f"CASE g {cases} END AS x{j}" + (", " if j == 0 else ""))
        parts.append(f""" FROM {rows} WHERE ({weight}) > 0),
{out}_0 AS (SELECT DISTINCT g, 0.0::double AS w0, 0.0::double AS w1 FROM {out}_rows)""")
        for t in range(steps):
            parts.append(f""",
{out}_s{t} AS (SELECT g, w0, w1, sum(w * (p - label) * x0) AS a, sum(w * (p - label) * x1) AS b,
    sum(w * p * (1 - p) * x0 * x0) AS h00, sum(w * p * (1 - p) * x0 * x1) AS h01, sum(w * p * (1 - p) * x1 * x1) AS h11
    FROM (SELECT r.*, w0, w1, 1 / (1 + exp(-(w0 * x0 + w1 * x1))) AS p FROM {out}_rows r JOIN {out}_{t} m USING (g))
    GROUP BY g, w0, w1),
{out}_{t + 1} AS (SELECT g,
    CASE WHEN h00 = 0 THEN 0.0 WHEN h11 = 0 THEN w0 - a / h00 ELSE w0 - (h11 * a - h01 * b) / (h00 * h11 - h01 * h01) END AS w0,
    CASE WHEN h11 = 0 THEN 0.0 WHEN h00 = 0 THEN w1 - b / h11 ELSE w1 - (h00 * b - h01 * a) / (h00 * h11 - h01 * h01) END AS w1
    FROM {out}_s{t})""")
        parts.append(f""",
{out} AS (SELECT * FROM {out}_{steps})""")
        return "".join(parts)

    def logit_guess(self, out: str, rows: str, model: str) -> str:
        """Class 1 where its score is over 0, for every row of ``rows``, which name the model in ``g``."""
        return f"""
{out} AS (SELECT r.*, (w0 * f0 + w1 * f1 > 0)::int::double AS prediction FROM {rows} r JOIN {model} m USING (g))"""

    def single_logit(self) -> str:
        return (
            self.base
            + ","
            + self.logit("lr", "(SELECT 0 AS g, * FROM train)")
            + ","
            + self.logit_guess("scored", "(SELECT 0 AS g, * FROM test)", "lr")
        )

    def bag_logits(self) -> str:
        """A regression per bag."""
        bags = " UNION ALL ".join(f"SELECT {b} AS g, {bag_weight(b, self.key)} AS bw, * FROM train" for b in range(BAGS))
        keep = {b: [kept_input(b, j) for j in range(self.d)] for b in range(BAGS)}
        return self.base + f",\nbags AS ({bags})," + self.logit("lr", "bags", "bw", keep)

    def fold_logits(self) -> str:
        """A regression for every fold left out."""
        return self.base + "," + self.logit("lr", "(SELECT k.k AS g, t.* FROM train t JOIN range(0, 10) k(k) ON t.fold <> k.k)")

    def bagging_trio(self) -> str:
        """Bag 0 is Bayes, bag 1 a logistic regression, bag 2 a tree."""
        masked = lambda b: ", ".join(
            f"CASE WHEN {kept_input(b, j)} THEN f{j} ELSE 0.0 END AS f{j}" for j in range(self.d)
        )
        counts = ", ".join(
            f"(p0 = {c})::int + (p1 = {c})::int + (p2 = {c})::int AS v{c}" for c in range(self.n_classes)
        )
        return (
            self.base
            + f""",
drawn AS (SELECT {bag_weight(0, self.key)} AS w, * FROM train),
bag1 AS (SELECT 1 AS g, rid, f0, f1, label, {bag_weight(1, self.key)} AS bw FROM train),
bag2 AS (SELECT 0 AS g, rid, {masked(2)}, label, {bag_weight(2, self.key)} AS bw FROM train),"""
            + self.fit("model", "(SELECT * FROM drawn WHERE w > 0)", "0", "w", {0: [kept_input(0, j) for j in range(self.d)]})
            + ","
            + self.guess("by_bayes", "test", "model")
            + ","
            + self.logit("lr", "bag1", "bw", {1: [kept_input(1, j) for j in range(self.d)]})
            + ","
            + self.logit_guess("by_logit", "(SELECT 1 AS g, * FROM test)", "lr")
            + ","
            + self.tree("tree", "bag2", weight="bw")
            + ","
            + self.tree_guess("by_tree", "(SELECT 0 AS g, * FROM test)", "tree")
            + f""",
both_ AS (SELECT b.rid, {', '.join('b.' + k for k in self.key)}, b.label, b.prediction AS p0, l.prediction AS p1,
                 t.prediction AS p2
          FROM by_bayes b JOIN by_logit l USING (rid) JOIN by_tree t USING (rid)),
scored AS (SELECT *, {self.winner([f'v{c}' for c in range(self.n_classes)])} AS prediction
           FROM (SELECT *, {counts} FROM both_))"""
        )

    def stacking_trio(self) -> str:
        """Level 0: Bayes, a logistic regression and a tree, out of fold; level 1: a logistic
        regression on the three copies."""
        others = "(SELECT k.k AS g, t.* FROM train t JOIN range(0, 10) k(k) ON t.fold <> k.k)"
        return (
            self.base
            + ","
            + self.fit("level0", others, "g")
            + ","
            + self.guess("by_bayes", "train", "level0", "m.g = x.fold")
            + ","
            + self.logit("lr", others)
            + ","
            + self.logit_guess("by_logit", "(SELECT fold AS g, * FROM train)", "lr")
            + ","
            + self.tree("tree", others)
            + ","
            + self.tree_guess("by_tree", "(SELECT fold AS g, * FROM train)", "tree")
            + """,
copies AS ("""
            + " UNION ALL ".join(
                f"SELECT 0 AS g, f0, f1, prediction AS label FROM {c}" for c in ("by_bayes", "by_logit", "by_tree")
            )
            + "),"
            + self.logit("top", "copies")
            + ","
            + self.logit_guess("scored", "(SELECT 0 AS g, * FROM test)", "top")
        )

    def single(self) -> str:
        return self.base + "," + self.fit("model", "train") + "," + self.guess("scored", "test", "model")

    def bagging(self) -> str:
        weights = []
        for b in range(BAGS):
            weights.append(f"SELECT {b} AS bag, {bag_weight(b, self.key)} AS w, * FROM train")
        keep = {b: [kept_input(b, j) for j in range(self.d)] for b in range(BAGS)}
        counts = ", ".join(
            f"count(*) FILTER (prediction = {c})::int AS v{c}" for c in range(self.n_classes)
        )
        bag_votes = ", ".join(f"max(prediction) FILTER (g = {b}) AS p{b}" for b in range(BAGS))
        return (
            self.base
            + ",\nbagged AS ("
            + " UNION ALL ".join(weights)
            + "),\ndrawn AS (SELECT * FROM bagged WHERE w > 0),"
            + self.fit("model", "drawn", "bag", "w", keep)
            + ","
            + self.guess("guessed", "test", "model")
            + f""",
votes AS (SELECT rid, {', '.join(self.key)}, label, {bag_votes}, {counts} FROM guessed GROUP BY ALL),
scored AS (SELECT *, {self.winner([f'v{c}' for c in range(self.n_classes)])} AS prediction FROM votes)"""
        )

    @staticmethod
    def winner(counts: list[str]) -> str:
        best = f"greatest({', '.join(counts)})"
        return "CASE " + " ".join(f"WHEN {c} = {best} THEN {i}.0" for i, c in enumerate(counts)) + " END::double"

    def out_of_fold(self, last: int) -> str:
        """Pseudo-labels of folds 0..last, each by the model of the other folds."""
        others = "(SELECT k.k, t.* FROM train t JOIN range(0, 10) k(k) ON t.fold <> k.k)"
        return (
            self.base
            + ","
            + self.fit("level0", others, "k")
            + ","
            + self.guess("pseudo", f"(SELECT * FROM train WHERE fold <= {last})", "level0", "m.g = x.fold")
            + f""",
copies AS (SELECT c.model, p.rid, {', '.join(self.key)}, {names('f', self.d)}, p.prediction AS label
           FROM pseudo p, range(0, 2) c(model))"""
        )

    def stacking(self, last: int) -> str:
        return (
            self.out_of_fold(last)
            + ","
            + self.fit("model", "copies")
            + ","
            + self.guess("scored", "test", "model")
        )


LI = "f0 >= f2 AND f0 >= f3"
LINEITEM = LabelledSet(
    "lineitem",
    sets.LINEITEM_KEY,
    [scaled(a.name, a.range_min, a.range_max) for a in sets.LINEITEM_REALS],
    position("l_returnflag", sets.RETURN_FLAGS),
    3,
)
DOMINANT = LabelledSet(
    "lineitem",
    sets.LINEITEM_KEY,
    [scaled(a.name, a.range_min, a.range_max) for a in sets.LINEITEM_REALS],
    f"CASE WHEN {LI} THEN 0.0 WHEN f2 >= f3 THEN 1.0 ELSE 2.0 END::double",
    3,
)
WIDE = LabelledSet(
    "embeddings",
    ("vec_id",),
    [scaled(f"{sign}embedding[{i}]::double", -1, 1) for sign in ("", "-") for i in range(1, sets.EMBEDDING_SIZE + 1)],
    "label::double",
    10,
)
ORDERS = LabelledSet(
    "orders",
    ("o_orderkey",),
    [scaled("o_totalprice", 1000, 500000), position(PRIORITY, sets.PRIORITIES)],
    position("o_orderstatus", sets.ORDER_STATUS),
    3,
)
DISCRETE = LabelledSet(
    "lineitem",
    sets.LINEITEM_KEY,
    [scaled(a.name, a.range_min, a.range_max) for a in sets.LINEITEM_DISCRETE],
    "CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0.0 WHEN f1 >= f2 THEN 1.0 ELSE 2.0 END::double",
    3,
)
_PRICE, _DISCOUNT = sets.LINEITEM_REALS[1:3]
OVERLAP = LabelledSet(
    "lineitem",
    sets.LINEITEM_KEY,
    [scaled(a.name, a.range_min, a.range_max) for a in (sets.LINEITEM_REALS[0], _DISCOUNT)],
    f"({scaled(_PRICE.name, _PRICE.range_min, _PRICE.range_max)} >= f1)::int::double",
    2,
)
DOCUMENTS = LabelledSet(
    "documents",
    ("doc_id",),
    [
        scaled(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::double", 0, 100)
        for c in sets.LETTERS
    ],
    position("lang", sets.LANGS),
    4,
)


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def score(full: bool = True, rows: str = "scored") -> str:
    extra = f", {rounded('r::double / n')} AS accuracy_rounded" if full else ""
    return f"""SELECT r AS "right", n AS total, r::double / n AS accuracy{extra}
FROM (SELECT count(*) FILTER (prediction = label) AS r, count(*) AS n FROM {rows})"""


DOMAINS = f"""domains AS (
  SELECT string_agg(DISTINCT {PRIORITY}, ', ' ORDER BY {PRIORITY}) AS p,
         string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS s,
         count(DISTINCT o_orderpriority) AS np, count(DISTINCT o_orderstatus) AS ns FROM orders)"""

HEADER = """SELECT 0 AS position, '@relation orders' AS value FROM domains
UNION ALL SELECT 1, '@attribute o_totalprice real [1000, 500000]' FROM domains
UNION ALL SELECT 2, '@attribute o_orderpriority {' || p || '}' FROM domains
UNION ALL SELECT 3, '@attribute o_orderstatus {' || s || '}' FROM domains
UNION ALL SELECT 4, '@inputs o_totalprice, o_orderpriority' FROM domains
UNION ALL SELECT 5, '@outputs o_orderstatus' FROM domains
UNION ALL SELECT 6, '@data' FROM domains"""

LOAD_REPORT = f"""SELECT count(*) AS "rows", 0::bigint AS wrong_field_count, 0::bigint AS bad_number,
count(*) FILTER (p = lp) AS unknown_nominal, count(*) FILTER (s = ls) AS unknown_class,
min(line) FILTER (s = ls) AS example, count(*) FILTER (s <> ls) AS kept
FROM (SELECT {PRIORITY} AS p, o_orderstatus AS s, max({PRIORITY}) OVER () AS lp, max(o_orderstatus) OVER () AS ls,
o_totalprice::varchar || ', ' || {PRIORITY} || ', ' || o_orderstatus AS line FROM orders)"""

PRIORITY_CODE = f"(dense_rank() OVER (ORDER BY {PRIORITY}) - 1)::double"
STATUS_CODE = "(dense_rank() OVER (ORDER BY o_orderstatus) - 1)::double"


def _value_counts(attribute: str, value: str, table: str, values, by: str = "", classes=("",)) -> str:
    rows = ", ".join(
        f"({i}, '{v}'" + (f", {c})" if by else ")") for i, v in enumerate(values) for c in range(len(classes))
    )
    if not by:
        return f"""SELECT '{attribute}' AS attribute, d.code::int AS code, d.value AS value, count(t.v) AS n
FROM (VALUES {rows}) d(code, value) LEFT JOIN (SELECT {value} AS v FROM {table}) t ON t.v = d.value
GROUP BY ALL"""
    return f"""SELECT '{attribute}' AS attribute, d.code::int AS code, d.value AS value, d.label::double AS label,
count(t.v) AS n FROM (VALUES {rows}) d(code, value, label)
LEFT JOIN (SELECT {value} AS v, {by} AS c FROM {table}) t ON t.v = d.value AND t.c = d.label GROUP BY ALL"""


STATUS_LABEL = position("l_linestatus", sets.LINE_STATUS)

ORACLE: dict[str, str] = {
    "keel_header": with_(DOMAINS, f"SELECT position::int AS position, value FROM ({HEADER})"),
    "keel_attributes": with_(
        DOMAINS,
        """SELECT 0::int AS position, 'o_totalprice' AS name, 'r' AS kind, 'i' AS io,
1000.0::double AS range_min, 500000.0::double AS range_max, '' AS "values" FROM domains
UNION ALL SELECT 1, 'o_orderpriority', 'n', 'i', 0.0, np - 1, replace(p, ', ', '|') FROM domains
UNION ALL SELECT (2 + row_number() OVER (ORDER BY o_orderstatus) - 1)::int, o_orderstatus, 'n', 'o', 0.0, 1.0, '0|1'
FROM (SELECT DISTINCT o_orderstatus FROM orders)""",
    ),
    "dataset_summary": with_(
        DOMAINS,
        """SELECT 2::int AS n_input, ns::int AS n_output, (2 + ns)::int AS n_attributes,
(SELECT count(*) FROM orders) AS n_instances, replace(s, ', ', '|') AS classes FROM domains""",
    ),
    "keel_load": f"""SELECT o_orderkey AS row_id, o_totalprice AS x0, {PRIORITY_CODE} AS x1,
{scaled('o_totalprice', 1000, 500000)} AS f0, {PRIORITY_CODE} AS f1,
({STATUS_CODE} = 0)::int::double AS c0, ({STATUS_CODE} = 1)::int::double AS c1,
({STATUS_CODE} = 2)::int::double AS c2, {STATUS_CODE} AS label FROM orders""",
    "keel_text_load": f"""SELECT o_totalprice AS x0, {PRIORITY_CODE} AS x1,
{scaled('o_totalprice', 1000, 500000)} AS f0, {PRIORITY_CODE} AS f1, {STATUS_CODE} AS label FROM orders""",
    "keel_file_headers": with_(DOMAINS, f"""SELECT part::int AS part, position::int AS position, value
FROM ({HEADER}), range(0, {sets.ORDERS_FILES}) r(part)"""),
    "keel_declarations": with_(
        DOMAINS,
        f"""SELECT {sets.ORDERS_FILES}::bigint AS files, '@attribute o_totalprice real[1000,500000]; @attribute o_orderpriority{{'
|| replace(p, ', ', ',') || '}}; @attribute o_orderstatus{{' || replace(s, ', ', ',')
|| '}}; @inputs o_totalprice,o_orderpriority; @outputs o_orderstatus' AS declaration FROM domains""",
    ),
    "keel_count": "SELECT count(*) AS n FROM orders",
    "keel_load_report": f"SELECT * EXCLUDE (kept) FROM ({LOAD_REPORT})",
    "keel_load_observed": LOAD_REPORT,
    "nominal_encode": f"SELECT o_orderkey, {position(PRIORITY, sets.PRIORITIES[:4])} AS code FROM orders",
    "nominal_encode_wide": f"""SELECT {LINEITEM_KEY}, CASE WHEN l_shipdate::date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'
THEN date_diff('day', DATE '1995-01-01', l_shipdate::date) ELSE -1 END::double AS code FROM lineitem""",
    "class_onehot": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::double AS c0,
CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::double AS c1,
CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::double AS c2 FROM orders""",
    "label_from_onehot": """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 2.0 WHEN o_totalprice > 250000 THEN 1.0
WHEN o_orderstatus = 'F' THEN 0.0 ELSE -1.0 END::double AS label FROM orders""",
    "declared_range_rescale": f"SELECT {LINEITEM_KEY}, {LINEITEM_FEATURES} FROM lineitem",
    "labelled_points": f"""SELECT {LINEITEM_KEY}, {position('l_returnflag', sets.RETURN_FLAGS)} AS label,
{LINEITEM_FEATURES} FROM lineitem""",
    "events_points": f"""SELECT event_id, {scaled('value', 0, 500)} AS f0, (user_id % 50)::double AS f1,
{position('event_type', sets.EVENT_TYPES)} AS label FROM events""",
    "embeddings_points": """SELECT vec_id, label::double AS label, (i - 1)::int AS position,
(embedding[i]::double + 1.0::double) / 2.0::double AS value
FROM embeddings, range(1, 65) r(i)""",
    "nominal_value_counts": _value_counts("o_orderpriority", PRIORITY, "orders", sets.PRIORITIES),
    "nominal_value_class_counts": _value_counts(
        "l_returnflag", "l_returnflag", "lineitem", sets.RETURN_FLAGS, STATUS_LABEL, sets.LINE_STATUS
    )
    + "\nUNION ALL\n"
    + _value_counts(
        "l_linenumber",
        "l_linenumber::varchar",
        "lineitem",
        [str(i) for i in range(1, 8)],
        STATUS_LABEL,
        sets.LINE_STATUS,
    ),
    "train_test_split": with_(LINEITEM.base, f"SELECT {LINEITEM_KEY}, part FROM base"),
    "fold_assign": with_(LINEITEM.base, f"SELECT {LINEITEM_KEY}, fold FROM train"),
    "keyless_draws": f"""WITH lines AS (SELECT l_quantity::int || ', ' || l_returnflag || ', ' || l_linestatus AS value,
l_quantity::int::double AS x0, {position('l_returnflag', sets.RETURN_FLAGS)} AS x1,
{position('l_linestatus', sets.LINE_STATUS)} AS label FROM lineitem),
keyed AS (SELECT *, md5((row_number() OVER (PARTITION BY value) - 1)::varchar || '|' || value) AS row_id FROM lines)
SELECT row_id, x0, x1, label, CASE WHEN {draw('split', ['row_id'])} < 0.6 THEN 'train' ELSE 'test' END AS part,
floor({draw('fold', ['row_id'])} * 10)::int AS fold, {bag_weight(0, ['row_id'])} AS bag0, {bag_weight(1, ['row_id'])} AS bag1
FROM keyed""",
    "fold_complement_counts": with_(
        LINEITEM.base,
        """SELECT k::int AS fold, count(*) FILTER (fold = k) AS held_out, count(*) FILTER (fold <> k) AS trained_on
FROM train, range(0, 10) r(k) GROUP BY k""",
    ),
    "bootstrap_weights": with_(
        LINEITEM.base,
        f"SELECT {LINEITEM_KEY}, "
        + ", ".join(f"{bag_weight(b, sets.LINEITEM_KEY)} AS bag{b}" for b in range(BAGS))
        + " FROM train",
    ),
    "attribute_mask": with_(
        LINEITEM.base,
        f"SELECT {LINEITEM_KEY}, "
        + ", ".join(
            f"CASE WHEN {kept_input(b, j)} THEN f{j} ELSE 0.0 END::double AS bag{b}_f{j}"
            for b in range(2)
            for j in range(4)
        )
        + " FROM train",
    ),
    "nb_model": with_(
        LINEITEM.base + "," + LINEITEM.fit("model", "train"),
        "SELECT label, round(pi, 6) AS pi, "
        + ", ".join(f"round(t{j}, 6) AS theta{j}" for j in range(4))
        + " FROM model",
    ),
    "nb_predict": with_(DOCUMENTS.single(), "SELECT doc_id, label, prediction FROM scored"),
    "wide_nb_predict": with_(WIDE.single(), "SELECT vec_id, label, prediction FROM scored"),
    "wide_nb_sums": with_(
        WIDE.base,
        "SELECT label, count(*)::double AS n, "
        + ", ".join(f"round(sum(f{j}), 6) AS s{j}" for j in (0, 63, 64, 127))
        + " FROM train GROUP BY label",
    ),
    "single_nb_accuracy": with_(DOCUMENTS.single(), score(full=False)),
    "accuracy_observed": with_(DOCUMENTS.single(), score(full=False)),
    "single_nb_lineitem": with_(DOMINANT.single(), score(full=False)),
    "accuracy_rounded": with_(
        DOCUMENTS.single(),
        f"""SELECT label, {rounded("count(*) FILTER (prediction = label)::double / count(*)")} AS accuracy_rounded
FROM scored GROUP BY label""",
    ),
    "lr_predict": with_(OVERLAP.single_logit(), f"SELECT {LINEITEM_KEY}, label, prediction FROM scored"),
    "single_lr": with_(OVERLAP.single_logit(), score(full=False)),
    "lr_bag_weights": with_(
        OVERLAP.bag_logits(), "SELECT g::int AS bag, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM lr"
    ),
    "lr_fold_weights": with_(
        OVERLAP.fold_logits(), "SELECT g::int AS fold, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM lr"
    ),
    "lr_gradients": with_(
        OVERLAP.base
        + """,
members AS ("""
        + " UNION ALL ".join(
            f"SELECT {b} AS member, {bag_weight(b, sets.LINEITEM_KEY)} AS w, * FROM train" for b in range(BAGS)
        )
        + f""" UNION ALL SELECT {BAGS} + k.k, (fold <> k.k)::int, t.* FROM train t, range(0, 10) k(k)),
guessed AS (SELECT *, 1 / (1 + exp(-(0.5 * (1 + member) * f0 - 0.25 * member * f1))) AS p FROM members)""",
        "SELECT member::int AS member, round(sum(w)::double, 6) AS weight, "
        "round(sum(w * (p - label) * f0) / sum(w), 9) AS g0, round(sum(w * (p - label) * f1) / sum(w), 9) AS g1, "
        "round(-sum(w * CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) / sum(w), 9) AS loss "
        "FROM guessed GROUP BY member",
    ),
    "bagging_trio": with_(
        OVERLAP.bagging_trio(), f"SELECT {LINEITEM_KEY}, label, p0, p1, p2, prediction FROM scored"
    ),
    "stacking_trio": with_(OVERLAP.stacking_trio(), f"SELECT {LINEITEM_KEY}, label, prediction FROM scored"),
    "lr_moments": with_(
        ORDERS.base,
        "SELECT c.c::double AS label, j.j::int AS feature, "
        "round(avg(CASE WHEN label = c.c THEN CASE j.j WHEN 0 THEN f0 ELSE f1 END ELSE 0.0 END), 2) AS moment "
        "FROM train, range(0, 3) c(c), range(0, 2) j(j) GROUP BY ALL",
    ),
    "dt_predict": with_(DISCRETE.single_tree(), f"SELECT {LINEITEM_KEY}, label, prediction FROM scored"),
    "single_dt": with_(DISCRETE.single_tree(), score(full=False)),
    "bagging_mixed": with_(
        DISCRETE.bagging_mixed(), f"SELECT {LINEITEM_KEY}, label, p0, p1, prediction FROM scored"
    ),
    "stacking_mixed": with_(DISCRETE.stacking_mixed(), f"SELECT {LINEITEM_KEY}, label, prediction FROM scored"),
    "dt_stump": with_(
        DOMINANT.base
        + """,
points AS ("""
        + " UNION ALL ".join(f"SELECT {j} AS feature, f{j} AS x, label FROM train" for j in range(4))
        + """),
steps AS (SELECT feature, x, count(*)::double AS n, """
        + ", ".join(f"count(*) FILTER (label = {c})::double AS k{c}" for c in range(3))
        + """ FROM points GROUP BY feature, x),
below AS (SELECT feature, x, lead(x) OVER w AS next_x, sum(n) OVER w AS n,
          sum(k0) OVER w AS c0, sum(k1) OVER w AS c1, sum(k2) OVER w AS c2 FROM steps
          WINDOW w AS (PARTITION BY feature ORDER BY x)),
whole AS (SELECT feature, sum(n) AS an, sum(k0) AS a0, sum(k1) AS a1, sum(k2) AS a2 FROM steps GROUP BY feature),
cuts AS (SELECT feature, (x + next_x) / 2 AS threshold, c0, c1, c2, a0 - c0 AS d0, a1 - c1 AS d1, a2 - c2 AS d2,
         n - (c0 * c0 + c1 * c1 + c2 * c2) / n
         + (an - n) - ((a0 - c0) * (a0 - c0) + (a1 - c1) * (a1 - c1) + (a2 - c2) * (a2 - c2)) / (an - n) AS impurity
         FROM below JOIN whole USING (feature) WHERE next_x IS NOT NULL)""",
        f"""SELECT feature::int AS feature, round(threshold, 6) AS threshold,
{LabelledSet.winner(['c0', 'c1', 'c2'])} AS prediction_below, {LabelledSet.winner(['d0', 'd1', 'd2'])} AS prediction_above
FROM cuts ORDER BY impurity LIMIT 1""",
    ),
    "vote_counts": with_(DOMINANT.bagging(), f"SELECT {LINEITEM_KEY}, v0, v1, v2 FROM scored"),
    "plurality_vote": with_(
        DOMINANT.bagging(),
        f"SELECT {LINEITEM_KEY}, CASE WHEN v1 > v0 THEN 1.0 ELSE 0.0 END::double AS prediction FROM scored",
    ),
    "bagging_nb_predictions": with_(
        DOMINANT.bagging(), f"SELECT {LINEITEM_KEY}, label, p0, p1, p2, prediction FROM scored"
    ),
    "bagging_nb_accuracy": with_(DOMINANT.bagging(), score()),
    "bagging_nb_documents": with_(DOCUMENTS.bagging(), score()),
    "pseudo_labels_nb": with_(
        DOMINANT.out_of_fold(9),
        f"SELECT {LINEITEM_KEY}, fold, prediction AS pseudo0, prediction AS pseudo1 FROM pseudo",
    ),
    "level1_training_nb": with_(
        DOMINANT.out_of_fold(9), f"SELECT {LINEITEM_KEY}, model::int AS model, label, f0, f1, f2, f3 FROM copies"
    ),
    "level1_test_nb": with_(
        DOMINANT.out_of_fold(9)
        + ","
        + DOMINANT.fit("model", "(SELECT * FROM copies WHERE model = 0)")
        + ","
        + DOMINANT.guess("scored", "test", "model"),
        f"SELECT {LINEITEM_KEY}, c.model::int AS model, prediction AS label FROM scored, range(0, 2) c(model)",
    ),
    "stacking_nb_accuracy": with_(DOMINANT.stacking(9), score()),
    "stacking_nb_historic": with_(DOMINANT.stacking(8), score()),
    "stacking_nb_all_folds": with_(DOMINANT.stacking(9), score()),
    "stacking_nb_documents": with_(DOCUMENTS.stacking(9), score()),
    "run_report": with_(
        DOCUMENTS.single(),
        f"""SELECT 'single' AS run, 'documents_lang' AS input, NULL::int AS num_partitions, 'NB 1.0' AS level0_models,
NULL::varchar AS level1_model, s.* FROM ({score()}) s""",
    ),
}
