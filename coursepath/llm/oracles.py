"""DuckDB SQL for the queries that SQL can express. Parameters are written out, not imported."""

_URL_PARTS = r"""
parts as (
    select page_id, url, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages
),
placed as (
    select page_id, url,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
        coalesce(case when instr(url, '://') > 0 then rest else url end, '') as body
    from parts
),
rules(rule, action, rhost, rpath) as (
    values ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
        ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
),
ruled as (
    select p.*, r.rule, r.action,
        '^^^' || regexp_replace(
            translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0./\-_?=&%#]', '~', 'g'
        ) || '$' as s,
        substring(md5(coalesce(url, '')), 1, 1) in ('0', '1', '2') as held
    from placed p left join lateral (
        select rule, action from rules
        where (p.host = rhost or ends_with(p.host, '.' || rhost)) and starts_with(p.path, rpath)
        order by length(rule) desc limit 1
    ) r on true
)
"""

# Both models side by side, as rows of a model column; each order's probability builds on the shorter one.
_URL_MODEL = r"""
texts as (select s, action, held, count(*) as n from ruled group by all),
at4 as (select s, action, held, n, unnest([substring(s, i, 4) for i in range(1, length(s) - 2)]) as g from texts),
models(m) as (values ('allow'), ('block')),
grams as (
    select m, g, coalesce(sum(n) filter (action = m and not held), 0) as n from at4, models group by m, g
),
o0 as (select m, g, n, (sum(n) over (partition by m, g[4:4]) + 1) / (sum(n) over (partition by m) + 39.0) as p from grams),
{orders}
model as (
    select a.g, ln(a.p) - ln(b.p) as d from o3 a join o3 b using (g) where a.m = 'allow' and b.m = 'block'
),
scores as (
    select s, sum(d) / count(*) as score
    from (select s, unnest([substring(s, i, 4) for i in range(1, length(s) - 2)]) as g from (select distinct s from texts)) join model using (g)
    group by s
),
bins as (
    select greatest(-500, least(500, floor(score * 100))) as step, coalesce(sum(n) filter (action = 'allow'), 0) as a, coalesce(sum(n) filter (action = 'block'), 0) as b
    from texts join scores using (s) where held and action is not null group by 1
),
tries as (
    select t, sum(case when step >= t then a else 0 end) * (select sum(b) from bins) + sum(case when step < t then b else 0 end) * (select sum(a) from bins) as good
    from range(-500, 501) r(t), bins group by t
),
bar as (
    select case when (select sum(a) from bins) > 0 and (select sum(b) from bins) > 0
        then (select t / 100.0 from tries order by good desc, abs(t), t limit 1) else 0 end as bar
)
"""

_ORDER = """
k{o} as (
    select m, g, n, p, sum(n) over (partition by m, g[{a}:4]) as k, sum(n) over (partition by m, g[{a}:3]) as seen from o{q}
),
d{o} as (select m, g[{a}:3] as h, count(distinct g[{a}:4]) as kinds from k{o} where k > 0 group by 1, 2),
o{o} as (
    select k.m, g, n, case when seen > 0 then (k + coalesce(kinds, 0) * p) / (seen + coalesce(kinds, 0)) else p end as p
    from k{o} k left join d{o} d on d.m = k.m and d.h = k.g[{a}:3]
),
"""

OP3 = (
    "with "
    + _URL_PARTS
    + ","
    + _URL_MODEL.replace("{orders}", "".join(_ORDER.format(o=o, q=o - 1, a=4 - o) for o in (1, 2, 3)))
    + """
select page_id, host, path, rule, coalesce(action, case when score >= bar then 'allow' else 'block' end) as verdict
from ruled join scores using (s), bar
"""
)

# Every window that holds a shared five-word shingle, compared by its bag of shingles.
OP1 = r"""
with docs as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
items as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
doc_grams as (
    select doc_id, p, array_to_string(w[p + 1:p + 5], ' ') as g from (select doc_id, w, unnest(range(0, len(w) - 4)) as p from docs where len(w) > 4)
),
item_grams as (
    select item_id, n, q, array_to_string(w[q + 1:q + 5], ' ') as g
    from (select item_id, w, len(w) as n, unnest(range(0, len(w) - 4)) as q from items where len(w) > 4)
),
shared as (
    select distinct doc_id, item_id, n, p, len(w) as words from doc_grams join (select distinct item_id, n, g from item_grams) using (g) join docs using (doc_id)
),
starts as (
    select distinct doc_id, item_id, n, unnest(range(greatest(0, p - n + 5), least(p, greatest(0, words - n)) + 1)) as start from shared
),
windows as (select s.*, w[start + 1:start + n] as w from starts s join docs using (doc_id)),
bags as (
    select doc_id, item_id, n, start, array_to_string(w[k + 1:k + 5], ' ') as g, count(*) as c
    from (select *, unnest(range(0, len(w) - 4)) as k from windows) group by all
),
item_bags as (select item_id, g, count(*) as c from item_grams group by all),
common as (
    select b.doc_id, b.item_id, b.n, b.start, sum(least(b.c, coalesce(i.c, 0))) as s, sum(b.c) as tw
    from bags b left join item_bags i on i.item_id = b.item_id and i.g = b.g group by all
),
alike as (
    select doc_id, item_id, n, start, s::double / (tw + ti - s)::double as similarity
    from common join (select item_id, sum(c) as ti from item_bags group by all) using (item_id)
)
select doc_id, item_id, similarity, start::int as start, n::int as n_words from alike where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
"""

# All pairs, and all that each vector reaches.
OP5 = """
with recursive v as (
    select vec_id, list_transform(embedding::double[], lambda x: x / pow(2, floor(log2(list_max(list_transform(embedding::double[], lambda y: abs(y))))))) as e
    from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link as (
    select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join link l on l.x = r.y)
select vec_id, count(y) as n_links, component_id, vec_id = component_id as kept
from (select x as vec_id, min(y) as component_id from reach group by x) left join link on link.x = vec_id
group by vec_id, component_id
"""

# The licence notices.
_TEMPLATES = """
    ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
    ('Apache-2.0', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ('MIT', 'Released under the MIT License.'),
    ('MIT', 'This project is licensed under the MIT License.'),
    ('MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
    ('GPL-2.0', 'This work is licensed under the GNU General Public License, version 2.'),
    ('GPL-3.0', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ('LGPL-2.1', 'This work is licensed under the GNU Lesser General Public License, version 2.1.'),
    ('AGPL-3.0', 'This work is licensed under the GNU Affero General Public License, version 3.'),
    ('MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
    ('BSD-3-Clause', 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.'),
    ('BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:'),
    ('ISC', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ('CC-BY-4.0', 'Licensed under CC BY 4.0.'),
    ('CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
    ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
    ('CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
    ('CC0-1.0', 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.'),
    ('Unlicense', 'This is free and unencumbered software released into the public domain.')
"""

OP6 = r"""
with templates(license, t) as (values """ + _TEMPLATES + r"""),
known as (
    select license, t, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as b
    from (select *, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from templates)
),
passages as (
    select doc_id, unnest(list_concat(string_split(body, chr(10)), list_filter(string_split_regex(body, '\n\s*\n'), lambda p: contains(trim(p), chr(10))))) as p
    from (select doc_id, lower(coalesce(text, '')) as body from documents)
),
numbered as (
    select row_number() over () as k, doc_id, list_filter(string_split_regex(p, '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
    from passages where regexp_matches(p, 'licen|permission|redistribut|unencumbered|waived|free software')
),
sized as (select k, doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as a from numbered where len(w) > 1),
scored as (
    select k, doc_id, license, 2 * len(list_intersect(a, b)) / (len(a) + len(b))::double as dice
    from sized join known on len(a) between 0.73 * len(b) and 1.36 * len(b)
),
best as (
    select * from scored where dice >= 0.85 qualify row_number() over (partition by k order by dice desc, license) = 1
)
select doc_id, license, max(dice) as dice, count(*) as n_passages from best group by doc_id, license
"""

OP11 = """
with split as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as all_lines from documents
),
lines as (
    select doc_id, unnest(all_lines) as line, generate_subscripts(all_lines, 1) as i from split
),
keyed as (
    select *, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
    ) as k
    from lines
),
first_holder as (
    select k, min(doc_id) as keeps from keyed where length(k) >= 10 group by k
),
judged as (
    select keyed.*, coalesce(doc_id <> keeps, false) as dropped from keyed left join first_holder using (k)
)
select
    doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op3_url_models": OP3,
    "op5_embedding_pq": OP5,
    "op6_license_dice": OP6,
    "op11_line_store": OP11,
}
