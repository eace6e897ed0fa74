"""The same queries as SQL for DuckDB over the same tables."""

# Named sub-selects; each query lists those it needs, in order.
PARTS = {
    "views": """
        select case when l_returnflag = 'A' then 'other-search' else 'supp-' || l_suppkey end as prev,
               'part-' || l_partkey as curr,
               case l_returnflag when 'N' then 'link' when 'R' then 'other' else 'external' end as link,
               cast(l_quantity as bigint) as n,
               cast(1704067200 + (l_orderkey * 37 + l_linenumber * 11) % 3600 as bigint) as ts,
               l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as row_id,
               l_linenumber as line_number
        from lineitem""",
    "view_lines": """
        select prev || chr(9) || curr || chr(9) || link || chr(9) || n as value from views""",
    "change_events": """
        select event_id,
               cast(1704067200 + floor((datediff('second', TIMESTAMP '1970-01-01',
                 date_trunc('second', ts)) - 1704067200) / 120.0) as bigint) as timestamp,
               case event_type when 'view' then 'enwiki' when 'click' then 'frwiki'
                 when 'purchase' then 'dewiki' when 'error' then 'commonswiki'
                 else 'wikidatawiki' end as wiki,
               'Page_' || user_id as title,
               case when event_id % 10 < 8 then 'edit' else 'new' end as type
        from events""",
    "categories": """
        select 'Page_' || p_partkey as title, 0 as pos, 'Category:' || p_brand as category,
               p_size % 7 = 0 as hidden from part
        union all
        select 'Page_' || p_partkey, 1, 'Category:' || p_type || ' stubs', false from part
        union all
        select 'Page_' || p_partkey, 2, 'Category:' || p_type || ' goods', false from part""",
    "edits": """
        select e.timestamp, e.wiki, e.title, replace(c.category, 'Category:', '') as categoryText
        from change_events e join categories c on e.title = c.title
        where e.type = 'edit' and not c.hidden""",
    "page_windows": """
        select curr, (ts // 120) * 120 - i * 120 as window_start, cast(sum(n) as bigint) as value
        from views cross join range(0, 2) t(i) group by all""",
    "top_pages": """
        select curr as key, cast(sum(n) as bigint) as value from views
        group by curr order by value desc, key limit 10""",
    "top_windows": """
        select curr as key, value, window_start from page_windows
        order by value desc, key, window_start limit 20""",
    # The words of the noise filter, and the names of topics below.
    "quiet": """
        select * from edits where wiki = 'enwiki' and not regexp_matches(categoryText,
          'Articles|articles|Wikidata|Noindexed|external|Pages|pages|CS1|AfD|AC|Stubs|stub')""",
    "category_counts": """
        select categoryText as key, (timestamp // 120) * 120 - i * 120 as window_start,
               count(*) as value
        from quiet cross join range(0, 15) t(i) group by all having count(*) >= 5""",
    "wiki_counts": """
        select wiki as key, (timestamp // 60) * 60 - i * 60 as window_start, count(*) as value
        from edits cross join range(0, 5) t(i) group by all having count(*) >= 20""",
    "results": """
        select 'top_resource' as topic, key, value, 0 as offset_ from top_pages
        union all select 'top_resource_sliding', key, value, window_start from top_windows
        union all select 'event_top_categories', key, value, window_start from category_counts
        union all select 'event_wikitype', key, value, window_start from wiki_counts""",
    "last_of_batch": """
        select topic, key, arg_max(value, (offset_ % 4) * 10000000000 + offset_) as value
        from results group by topic, key""",
    "latest_ranked": """
        select *, row_number() over (partition by topic order by value desc, key) as rank
        from last_of_batch""",
    "keyed": """
        select topic, key, max(value) as value from results group by topic, key""",
    "ranked": """
        select *, row_number() over (partition by topic order by value desc, key) as rank
        from keyed""",
    "words": r"""
        select title, pos, unnest(w) as term, unnest(range(0, len(w))) as word
        from (select title, pos,
                     string_split_regex(replace(category, 'Category:', ''), '[^\p{L}\p{N}]+') as w
              from categories)""",
    "terms": r"""
        select title, term, count(*) as count, min((pos::bigint << 32) + word) as first_place
        from words
        where term <> '' and not regexp_full_match(term, '\p{N}+') and term <> 'Wikipedia'
        group by title, term""",
    "labels_of": """
        select title, term as category from (
          select *, row_number() over (partition by title order by count desc, first_place) as r
          from terms) where r = 1""",
    "titled": """
        select v.* replace (replace(curr, 'part-', 'Page_') as curr), l.category
        from views v left join labels_of l on l.title = replace(v.curr, 'part-', 'Page_')""",
    "seeds": """
        select *, cast('0x' || substr(digest, 1, 15) as bigint) % 2147483647 as start,
               cast('0x' || substr(digest, 16, 15) as bigint) % 2147483646 + 1 as step
        from (select *, md5('0|' || row_id) as digest from titled)""",
    "copies": """
        select *, unnest(range(0, n)) as copy from seeds where n > 0""",
    "expanded": """
        select *, TIMESTAMP '2021-05-01 00:00:00' + to_seconds(second) as date from (
          select *, (xor(y, y >> 13) * 69621) % 2147483647 % 2635200 as second from (
            select *, (xor(x, x >> 15) * 48271) % 2147483647 as y from (
              select *, (start + copy * step) % 2147483647 as x from copies)))""",
    "sorted": """
        select *, row_number() over (order by date, row_id, copy) - 1 as idx from expanded""",
}

_EDITS = ("change_events", "categories", "edits")
_RESULTS = ("views", "page_windows", "top_pages", "top_windows", *_EDITS, "quiet",
            "category_counts", "wiki_counts", "results")
_LABELS = ("categories", "words", "terms", "labels_of")
_EXPANDED = ("views", *_LABELS, "titled", "seeds", "copies", "expanded")

ORACLE = {}

# Row by row, for a test; too many rows for the checked queries.
SORTED_VIEWS = "with {} select idx, prev, curr, link, {} as date, category from sorted".format(
    ", ".join(f"{part} as ({PARTS[part]})" for part in (*_EXPANDED, "sorted")),
    "strftime(date, '%Y-%m-%d %H:%M:%S')",
)


def _sql(names, parts, body):
    head = ", ".join(f"{part} as ({PARTS[part]})" for part in parts)
    for name in names.split():
        ORACLE[name] = f"with {head} {body}" if head else body


_sql("parse_views", ["views"], "select prev, curr, link, n from views")
_sql("parse_views_malformed", ["views"],
     "select prev, curr, link, n from views where line_number in (1, 2, 3)")
_sql("parse_edits", _EDITS, "select * from edits")
_sql("change_event_parse", ["change_events"],
     """select event_id, type, title, timestamp, wiki, wiki || '.example' as domain,
               event_id + 7 as new_length, case when event_id % 2 = 0 then true end as patrolled,
               'said "so" {here}' as comment
        from change_events""")
_sql("json_concat_scan", ["change_events"],
     """select event_id, type, title, timestamp, wiki, wiki || '.example' as domain,
               event_id + 7 as new_length, 'said "so" {here}' as comment from change_events""")

_sql("top_resource top_resource_stream top_resource_bounded_stream", ["views", "top_pages"],
     "select key, cast(value as varchar) as value from top_pages")
_sql("page_totals", ["views"],
     "select curr, cast(sum(n) as bigint) as value from views group by curr")
_sql("view_window_sum", ["views", "page_windows"], "select * from page_windows")
_sql("processing_time_windows", ["views"],
     """select curr, cast(2 as bigint) as windows, cast(2 * sum(n) as bigint) as value
        from views group by curr""")
_sql("top_resource_sliding top_resource_sliding_stream top_resource_sliding_bounded_stream", ["views", "page_windows", "top_windows"],
     "select key, cast(value as varchar) as value, window_start from top_windows")
_sql("top_resource_latest_windows", ["views", "page_windows"],
     """select curr as key, value, window_start from page_windows
        where window_start > (select max(window_start) from page_windows) - 5 * 120
        order by value desc, key, window_start limit 20""")

_sql("category_noise_filter", [*_EDITS, "quiet"], "select * from quiet")
_sql("event_top_categories event_top_categories_stream event_top_categories_copied_stream", [*_EDITS, "quiet", "category_counts"],
     "select key, cast(value as varchar) as value, window_start from category_counts")
_sql("event_top_categories_closed_stream", [*_EDITS, "quiet", "category_counts"],
     """select key, cast(value as varchar) as value, window_start from category_counts
        where window_start + 1800 <= (select max(timestamp) from quiet) - 1800""")
_sql("event_wikitype event_wikitype_stream", [*_EDITS, "wiki_counts"],
     "select key, cast(value as varchar) as value, window_start from wiki_counts")
_sql("edit_counts_shared_stream", [*_EDITS, "quiet", "category_counts", "wiki_counts"],
     """select 'event_top_categories' as topic, key, cast(value as varchar) as value, window_start from category_counts
        union all select 'event_wikitype', key, cast(value as varchar), window_start from wiki_counts""")
_sql("event_wikitype_distinct event_wikitype_distinct_stream", _EDITS,
     """select wiki as key, (timestamp // 60) * 60 - i * 60 as window_start,
               cast(count(*) as varchar) as value
        from (select distinct timestamp, wiki, title from edits) cross join range(0, 5) t(i)
        group by all having count(*) >= 5""")
_sql("event_wikitype_distinct_id_stream", _EDITS[:2],
     """select wiki as key, (timestamp // 60) * 60 - i * 60 as window_start,
               cast(count(*) as varchar) as value
        from (select * from change_events e where type = 'edit' and exists (
                select 1 from categories c where c.title = e.title and not c.hidden))
          cross join range(0, 5) t(i)
        group by all having count(*) >= 5""")
_sql("edit_filter_project", ["change_events"],
     "select event_id, timestamp, wiki, title from change_events where type = 'edit'")
_sql("category_enrich", _EDITS, "select * from edits")
_sql("category_enrich_cut", _EDITS[:2],
     """select e.timestamp, e.wiki, e.title, replace(c.category, 'Category:', '') as categoryText
        from (select * replace (case when wiki in ('enwiki', 'frwiki') then 'Page_1' else title end
                                as title)
              from change_events where type = 'edit') e
        join categories c on e.title = c.title where not c.hidden""")
_sql("category_first_page", [],
     """with chosen as (
          select p_partkey as reply_id,
                 case when p_size % 3 = 0 then 'First' when p_size % 2 = 0 then 'Second'
                      else 'Missing' end as title,
                 case when p_size % 3 = 0 then ['Category:' || p_brand, 'Category:' || p_name]
                      when p_size % 2 = 0 then ['Category:' || p_type]
                      else ['Category:None'] end as texts
          from part)
        select reply_id, title, cast(unnest(range(0, len(texts))) as integer) as pos,
               unnest(texts) as category from chosen""")
_sql("edit_lines edit_lines_stream edit_lines_by_batch_stream edit_lines_by_part_stream", _EDITS,
     """select timestamp || chr(9) || wiki || chr(9) || title || chr(9) || categoryText as value
        from edits""")

_sql("result_view_max_per_key", [*_RESULTS, "keyed"], "select * from keyed")
_sql("result_view_latest_per_key", _RESULTS,
     """select topic, key, arg_max(value, offset_) as value, max(offset_) as "offset"
        from results group by topic, key""")
_sql("result_top_n result_view_stream", [*_RESULTS, "keyed", "ranked"],
     "select * from ranked where rank <= 100")
_sql("result_view_latest_stream", [*_RESULTS, "last_of_batch", "latest_ranked"],
     "select * from latest_ranked where rank <= 100")
_sql("result_share", [*_RESULTS, "keyed", "ranked"],
     """select *, cast(((value * 2000 + sum(value) over w) // (2 * sum(value) over w)) as double) / 10
               as share
        from ranked where rank <= 10 window w as (partition by topic)""")
_sql("result_topics_scan", _RESULTS,
     """select topic, key, cast(value as varchar) as value, offset_ % 4 as "offset" from results""")
_sql("latest_events latest_events_stream", ["change_events"],
     "select * from change_events order by timestamp desc, event_id desc limit 20")

_sql("page_terms", _LABELS[:3], "select * from terms")
_sql("page_main_category", _LABELS, "select * from labels_of")
_sql("view_enrich", ["views", *_LABELS, "titled"],
     "select prev, curr, link, n, row_id, category from titled")
_sql("view_enrich_cut", ["views", *_LABELS],
     """select v.curr, v.row_id, v.n, l.category
        from (select row_id, n, case when prev = 'other-search' then 'Page_1'
                                     else replace(prev, 'supp-', 'Page_') end as curr from views) v
        left join labels_of l on l.title = v.curr""")
_sql("expand_views", _EXPANDED,
     """select curr, link, category, cast(day(date) as integer) as day, count(*) as views,
               strftime(min(date), '%Y-%m-%d %H:%M:%S') as first_date,
               strftime(max(date), '%Y-%m-%d %H:%M:%S') as last_date,
               cast(sum(second) as bigint) as seconds,
               cast(sum(second * cast('0x' || substr(md5(concat_ws('|', prev, curr, link, category)), 1, 4) as bigint)) as bigint) as checksum
        from expanded group by curr, link, category, day(date)""")
_sql("expand_views_sorted", [*_EXPANDED, "sorted"],
     """select strftime(date, '%Y-%m-%d %H') as hour, count(*) as views, min(idx) as first_idx,
               max(idx) as last_idx,
               cast(sum(idx * cast('0x' || substr(md5(concat_ws('|', prev, curr, link, strftime(date, '%Y-%m-%d %H:%M:%S'), category)), 1, 4) as bigint)) as bigint) as checksum
        from sorted group by hour""")
_sql("date_functions", [],
     """select o_orderkey,
               datediff('second', TIMESTAMP '2021-05-01 00:00:00', o_orderdate) as span,
               strftime(o_orderdate + to_seconds(o_custkey), '%Y-%m-%d %H:%M:%S') as moved,
               o_custkey as epoch
        from orders""")
_sql("text_functions", [],
     """select o_orderkey, cast(substr(o_orderpriority, 1, 1) as bigint) as leading,
               cast(null as bigint) as no_leading, 'A Category:' || o_orderpriority as stripped,
               true as digits, false as no_digits, o_orderstatus || '  ' || o_custkey as spaced
        from orders""")

_sql("csv_roundtrip", ["views"],
     """select row_number() over (order by row_id, prev, curr, link, n) - 1 as idx,
               prev, curr, link, n, row_id from views""")
_sql("tsv_scan gzip_scan", ["views"], "select prev, curr, link, n from views")
_sql("split_files replay_stream", ["views", "view_lines"], "select * from view_lines")
_sql("tail_lines", ["views", "view_lines"],
     "select * from view_lines order by value desc limit 200")
_sql("message_encode", ["views"],
     """select '["' || prev || '","' || curr || '","' || link || '","' || n || '"]' as value
        from views""")
