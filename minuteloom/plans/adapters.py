"""Views of the given tables as minutes, sessions, questions and people; SQL that Spark and DuckDB both read."""

POINTS = """
SELECT l.l_orderkey AS meeting, l.l_linenumber AS sp, l.l_partkey AS partkey, l.l_suppkey AS suppkey, l.l_shipdate AS shipped,
  CAST(o.o_orderdate AS DATE) AS date, lower(r.r_name) AS commune, c.c_mktsegment AS rubrique,
  CASE WHEN l.l_returnflag = 'R' THEN 'question_orale' WHEN l.l_linenumber = 1 AND l.l_returnflag = 'A' THEN 'motion'
       WHEN l.l_linenumber = 2 AND l.l_returnflag = 'A' THEN 'demande_habitant' ELSE 'point' END AS type,
  concat(CASE l.l_partkey % 7 WHEN 0 THEN 'Budget ordinaire de l''exercice ' WHEN 1 THEN 'Subside à l''école ' WHEN 2 THEN 'Garantie communale '
         WHEN 3 THEN 'Réfection de la voirie ' WHEN 4 THEN 'Piste cyclable ' ELSE 'Marché public ' END, p.p_name) AS titre,
  CASE WHEN l.l_linestatus = 'F' AND l.l_suppkey % 3 = 0 THEN 'PREND ACTE' WHEN l.l_suppkey % 5 = 0 THEN 'Reporté' WHEN l.l_linestatus = 'O' THEN 'approuve' END AS decision,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'unanimite' WHEN 1 THEN 'vote_nominal' WHEN 2 THEN 'reporte' END AS vote_type,
  CAST(CASE WHEN l.l_linenumber = 7 THEN 0 ELSE l.l_extendedprice END AS DECIMAL(18,2)) AS montant,
  concat(replace(p.p_name, ' ', '_'), CASE WHEN l.l_partkey % 2 = 0 THEN 's' ELSE '' END) AS tag1, lower(p.p_type) AS tag2, s.s_name AS speaker, c.c_name AS author
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""

QUESTIONS = """
SELECT o_orderkey AS question, concat(CASE o_orderkey % 9 WHEN 0 THEN 'Quelles décisions des écoles en ' WHEN 1 THEN 'dès ' WHEN 2 THEN 'jusqu''en '
  WHEN 3 THEN 'entre 2020 et ' WHEN 4 THEN 'évolution 2012 ' WHEN 5 THEN 'budget ' WHEN 6 THEN 'comptes depuis ' WHEN 7 THEN 'depuis 1999, sans ' ELSE 'Travaux avant fin ' END,
  CASE WHEN o_orderkey % 11 = 0 THEN 'date' ELSE CAST(2000 + o_orderkey % 40 AS VARCHAR(4)) END, ' ?') AS text FROM orders"""

FILES = """
SELECT o_orderkey AS ord, o_custkey AS pub_key, o_orderstatus = 'F' AS is_fr, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS status, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  CASE o_orderkey % 4 WHEN 0 THEN concat('CC_', lpad(CAST(day(o_orderdate) AS VARCHAR(4)), 2, '0'), lpad(CAST(month(o_orderdate) AS VARCHAR(4)), 2, '0'), '20', lpad(CAST(year(o_orderdate) % 100 AS VARCHAR(4)), 2, '0'), '_1830')
    WHEN 1 THEN concat('PV-20', lpad(CAST(year(o_orderdate) % 100 AS VARCHAR(4)), 2, '0'), lpad(CAST(month(o_orderdate) AS VARCHAR(4)), 2, '0'), lpad(CAST(day(o_orderdate) AS VARCHAR(4)), 2, '0'))
    WHEN 2 THEN concat('pv_20', lpad(CAST(year(o_orderdate) % 100 AS VARCHAR(4)), 2, '0'), '.', CAST(month(o_orderdate) AS VARCHAR(4)), '.', CAST(day(o_orderdate) + 3 AS VARCHAR(4)))
    ELSE 'pv_2020.18.40' END AS name FROM orders"""

# the pages have no link to a PDF: their anchors are rewritten to the forms in which minutes are linked
LINKED = """
SELECT page_id, replace(replace(html, '<a href="/', concat('<a ', CASE page_id % 6 WHEN 0 THEN 'HREF="/document/pv-conseil-' WHEN 1 THEN 'src="//town.example/import/PV%20Conseil%20' WHEN 2 THEN 'data-file="/import/pv conseil '
  WHEN 3 THEN '"url" : "https://town.example/Notulen-' WHEN 4 THEN '''url'': ''/pv-2010-1-5-' ELSE 'href="/agenda-' END)), '">', CASE WHEN page_id % 6 = 4 THEN '.PDF''>' ELSE '.pdf">' END) AS html FROM pages"""

CHAPTERS = "SELECT user_id AS video_id, event_id AS chapter, ts AS start_s FROM events WHERE event_type = 'purchase'"
SEGMENTS = "SELECT user_id AS video_id, event_id AS segment, ts AS t, event_type AS text FROM events WHERE event_type <> 'purchase'"
CAPTIONS = "SELECT conv_id AS video_id, conv_id AS chapter, turn AS ord, CAST(turn * 5 AS DOUBLE) AS start_s, text FROM conversations"
CHUNKS = "SELECT vec_id AS id, embedding AS vector, 2000 + label AS year, CASE WHEN label % 2 = 0 THEN 'north' ELSE 'south' END AS commune, label FROM embeddings"
ASKED = "SELECT vec_id AS question, embedding AS q_vector, CASE WHEN label > 3 THEN 2002 END AS lo, CASE WHEN label < 7 THEN 2008 END AS hi, CASE WHEN label % 3 = 0 THEN 'north' END AS q_commune, label % 2 = 0 AS in_scope FROM embeddings WHERE vec_id % 20 = 0"
# first and last names made of a number's digits: as many people as the table has keys
first = lambda k: f"concat('J', translate(CAST({k} % 37 AS VARCHAR(9)), '0123456789', 'aeioulmnrs'))"
last = lambda k: f"concat('W', translate(CAST({k} AS VARCHAR(19)), '0123456789', 'aeioulmnrs'))"
F1, L1, L2 = first("c_custkey"), last("c_custkey"), last("c_custkey + 1")
NAMES = f"""
SELECT c_custkey AS id, {F1} AS f, {L1} AS l, {L2} AS l2, CASE c_custkey % 8 WHEN 0 THEN concat('M. ', {F1}, ' ', upper({L1})) WHEN 1 THEN concat('Mme. ', {L1}, ' ', {F1}) WHEN 2 THEN concat({L1}, ', Bourgmestre')
  WHEN 3 THEN concat('Van den ', {L1}, ' ', {F1}) WHEN 4 THEN concat('de ', {L1}) WHEN 5 THEN concat('MM. ', {L1}, ' et ', {F1}, ' ', {L2}) WHEN 6 THEN concat('Bourgmestre ', {F1}, ' ', {L1}) ELSE 'Secrétaire communal' END AS raw FROM customer"""
AMOUNTS = """
SELECT l_orderkey AS a, l_linenumber AS b, CASE l_linenumber % 5 WHEN 0 THEN 'gratuit' WHEN 1 THEN concat(CAST(l_partkey AS VARCHAR(20)), '.000 € TVAC')
  WHEN 2 THEN concat('1.', lpad(CAST(l_suppkey % 1000 AS VARCHAR(20)), 3, '0'), ',56 EUR HTVA') WHEN 3 THEN concat('1 ', lpad(CAST(l_suppkey % 1000 AS VARCHAR(20)), 3, '0'), ',50') ELSE '' END AS raw,
  CASE l_linenumber % 4 WHEN 0 THEN ' Oui' WHEN 1 THEN 'vrai' WHEN 2 THEN 'non' END AS flag, concat(CAST(l_linenumber AS VARCHAR(20)), CASE WHEN l_suppkey % 2 = 0 THEN ' bis' ELSE '' END) AS sp FROM lineitem"""
