"""Schemas of nested page data, as DDL."""

PAGE = "struct<num:int,section_id:string,topics:array<string>,terms:array<string>,summary:string,points:array<string>,chapter_intro:struct<title:string,overview:string>>"
PAGES_DATA = f"struct<chapters:array<struct<title:string,id:string>>,pages:array<{PAGE}>>"
BLOCKS = "struct<blocks:array<struct<lang:string,title:string,code:string>>>"
CHAPTER = "num int, title string, start int, end int, summary string, topics array<string>"
OVERVIEW = "struct<target_reader:string,overview:string,key_topics:array<string>,key_terms:array<struct<term:string,desc:string>>,must_read_pages:array<struct<page:int,why:string>>,study_guide:string,chapter_digests:array<struct<num:int,title:string,start:int,end:int,body:string>>>"
TABLE = "struct<title:string,headers:array<string>,rows:array<array<string>>,footer:string>"
SECTIONS = "array<struct<title:string,points:array<string>,tags:array<struct<text:string,core:boolean>>,subsections:array<struct<heading:string,points:array<string>>>>>"
LEDGER = "stage string, model string, tokens_in bigint, tokens_out bigint, usd decimal(18,4), ts string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
