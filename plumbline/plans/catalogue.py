"""Programs over the star schema with the SQL that says the same."""

from __future__ import annotations

from functools import partial

from plumbline.plans.compiler import answer

FLAGSHIP = "return customers ;return #1 from segment AUTOMOBILE ;return orders of #2 ;return number of #3 for each #2 ;return #2 where #4 is highest"
_PER = "SELECT c_custkey AS entity, {} AS answer FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
_TOTAL = "SELECT {} AS answer FROM orders"
_PRICES = "return orders ;return total price of #1 ;"

#: name -> (program, SQL)
PROGRAMS: dict[str, tuple[str, str]] = {
    "flagship": (
        FLAGSHIP,
        "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY 1) SELECT c_custkey AS answer FROM c WHERE n = (SELECT max(n) FROM c)",
    ),
    "select": ("return nations", "SELECT n_nationkey AS answer FROM nation"),
    "project": ("return nations ;return name of #1", "SELECT n_nationkey AS entity, n_name AS answer FROM nation"),
    "project_link": ("return customers ;return nation of #1 ;return name of #2", "SELECT n_nationkey AS entity, n_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "filter": ("return customers ;return #1 from segment BUILDING ;return balance of #2", "SELECT c_custkey AS entity, c_acctbal AS answer FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ref": ("return customers ;return orders of #1 ;return #2 with status F ;return #1 of #3", "SELECT c_custkey AS answer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    **{f"agg_{a}": (f"return orders ;return total price of #1 ;return {p} of #2", f"SELECT {f}(o_totalprice) AS answer FROM orders") for a, p, f in (("min", "lowest", "min"), ("max", "highest", "max"), ("count", "number", "count"))},
    "agg_sum": ("return parts ;return size of #1 ;return sum of #2", "SELECT sum(p_size)::BIGINT AS answer FROM part"),
    "agg_avg": ("return parts ;return size of #1 ;return average of #2", "SELECT avg(p_size) AS answer FROM part"),
    **{f"group_{a}": (f"return customers ;return orders of #1 ;return {'' if a == 'count' else 'total price of #2 ;return '}{p} of #{2 if a == 'count' else 3} for each #1", _PER.format(e)) for a, p, e in (("count", "number", "count(o_orderkey)"), ("min", "lowest", "min(o_totalprice)"), ("max", "highest", "max(o_totalprice)"))},
    "group_sum": ("return nations ;return customers of #1 ;return number of #2 for each #1 ;return sum of #3", "SELECT count(*) AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "group_avg": ("return regions ;return nations of #1 ;return number of #2 for each #1 ;return average of #3", "SELECT avg(n) AS answer FROM (SELECT count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey)"),
    **{
        f"group_{a}_each": (f"return orders ;return lines of #1 ;return quantity of #2 ;return {p} of #3 for each #1", f"SELECT o_orderkey AS entity, {a}(l_quantity) AS answer FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
        for a, p in (("sum", "sum"), ("avg", "average"))
    },
    **{f"superlative_{a}": (f"return parts ;return price of #1 ;return #1 where #2 is {p}", f"SELECT p_partkey AS answer FROM part WHERE p_retailprice = (SELECT {a}(p_retailprice) FROM part)") for a, p in (("max", "highest"), ("min", "lowest"))},
    "superlative_top": ("return parts ;return price of #1 ;return #1 where #2 is in top 5", "SELECT p_partkey AS answer FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5"),
    **{
        f"comparative_{k}": (f"return parts ;return {c} of #1 ;return #1 where #2 {p}", f"SELECT p_partkey AS answer FROM part WHERE {w}")
        for k, c, p, w in (
            ("gt", "size", "is higher than 40", "p_size > 40"), ("ge", "size", "is at least 40", "p_size >= 40"), ("lt", "size", "is less than ten", "p_size < 10"), ("le", "size", "is at most 10", "p_size <= 10"),
            ("eq", "size", "is equal to 7", "p_size = 7"), ("ne", "size", "is not 7", "p_size <> 7"), ("between", "size", "is between 10 and 20", "p_size BETWEEN 10 AND 20"), ("start", "brand", "starts with Brand#1", "starts_with(p_brand, 'Brand#1')"),
            ("end", "brand", "ends with 3", "ends_with(p_brand, '3')"), ("like", "type", "contains ECO", "contains(p_type, 'ECO')"),
        )
    },
    "comparative_ref": (_PRICES + "return average of #2 ;return #1 where #2 is higher than #3", "SELECT o_orderkey AS answer FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "union": ("return customers ;return suppliers ;return nation of #1 ;return nation of #2 ;return #3 , #4", "SELECT c_nationkey AS answer FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "intersection": (
        "return customers ;return #1 from segment AUTOMOBILE ;return nation of #2 ;return suppliers ;return nation of #4 ;return nations in both #3 and #5",
        "SELECT c_nationkey AS answer FROM customer WHERE c_mktsegment = 'AUTOMOBILE' INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "discard": (
        "return customers ;return orders of #1 ;return #2 with priority 1-URGENT ;return customer of #3 ;return #1 besides #4",
        "SELECT c_custkey AS answer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    ),
    "discard_literal": ("return nations ;return name of #1 ;return #2 besides FRANCE", "SELECT n_nationkey AS entity, n_name AS answer FROM nation WHERE n_name <> 'FRANCE'"),
    "sort": ("return parts ;return price of #1 ;return #1 sorted by #2", "SELECT p_partkey AS answer, row_number() OVER (ORDER BY p_retailprice, p_partkey)::INTEGER AS position FROM part"),
    "bool_compare": (_PRICES + "return number of #1 ;return if #3 is higher than ten", _TOTAL.format("CASE WHEN count(*) > 10 THEN 'yes' ELSE 'no' END")),
    "bool_and": (
        _PRICES + "return highest of #2 ;return lowest of #2 ;return if #3 is higher than 1000 ;return if #4 is lower than 10 ;return if both #5 and #6 are true",
        _TOTAL.format("CASE WHEN max(o_totalprice) > 1000 AND min(o_totalprice) < 10 THEN 'yes' ELSE 'no' END"),
    ),
    "bool_or": (
        _PRICES + "return highest of #2 ;return lowest of #2 ;return if #3 is higher than 1000 ;return if #4 is lower than 10 ;return if either #5 or #6 are true",
        _TOTAL.format("CASE WHEN max(o_totalprice) > 1000 OR min(o_totalprice) < 10 THEN 'yes' ELSE 'no' END"),
    ),
    "bool_false": (
        _PRICES + "return highest of #2 ;return lowest of #2 ;return if #3 is lower than 1000 ;return if #4 is lower than 10 ;return if both #5 and #6 are false",
        _TOTAL.format("CASE WHEN NOT max(o_totalprice) < 1000 AND NOT min(o_totalprice) < 10 THEN 'yes' ELSE 'no' END"),
    ),
    "bool_filter": ("return orders ;return if #1 with status F", _TOTAL.format("CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'yes' ELSE 'no' END")),
    "bool_exists": (
        "return customers ;return nation of #1 ;return suppliers ;return nation of #3 ;return if any #2 are the same as #4",
        "SELECT CASE WHEN count(*) > 0 THEN 'yes' ELSE 'no' END AS answer FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)",
    ),
    **{
        f"arith_{o}": (_PRICES + f"return highest of #2 ;return lowest of #2 ;return the {o} of #3 and #4", _TOTAL.format(e))
        for o, e in (("sum", "max(o_totalprice) + min(o_totalprice)"), ("difference", "abs(max(o_totalprice) - min(o_totalprice))"), ("multiplication", "max(o_totalprice) * min(o_totalprice)"), ("division", "max(o_totalprice) / min(o_totalprice)"))
    },
    **{
        f"comparison_{a}": (
            f"return orders ;return #1 with status F ;return #1 with status O ;return number of #2 ;return number of #3 ;return which is {p} of #4 , #5",
            _TOTAL.format(f"CASE WHEN count(*) FILTER (o_orderstatus = 'F') {c} count(*) FILTER (o_orderstatus = 'O') THEN '#4' WHEN count(*) FILTER (o_orderstatus = 'F') <> count(*) FILTER (o_orderstatus = 'O') THEN '#5' END"),
        )
        for a, p, c in (("max", "highest", ">"), ("min", "lowest", "<"))
    },
}

QUERIES = {f"q_{name}": partial(lambda spark, sf_dir, text: answer(spark, sf_dir, text), text=text) for name, (text, _) in PROGRAMS.items()}
SQL = {f"q_{name}": sql for name, (_, sql) in PROGRAMS.items()}
