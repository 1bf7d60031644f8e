"""The tables of the pipeline."""

from __future__ import annotations

ITEM = """id string, track string, status string, priority string, title string, url string, source_id string, source_name string, author string,
published_at string, captured_at string, dismissed_at string, summary string, tags array<string>, origin string, candidate_status string, image_url string,
editorial_title string, reference struct<feed_url:string,guid:string,original_url:string,resolved_from_url:string,raw_columns:map<string,string>>,
review struct<angle:string,research_status:string,structure_review:string,line_review:string,target_reader_review:string,fact_check:string,notes:string>,
local_decision struct<action:string,reason:string,decided_at:string>"""
SOURCE = """id string, track string, name string, source_group string, source_type string, fetch_frequency string, feed_url string, site_url string, status string,
required_keywords array<string>, excluded_keywords array<string>, last_fetched_at string, rss_health struct<last_checked_at:string,last_success_at:string,
last_fetch_status:string,last_error:string,entries_seen:int,new_items:int,skipped_old:int,skipped_duplicate_recent:int,skipped_source_keywords:int>, notes string"""
REVIEW_EVENT = "id string, item_id string, track string, step string, status string, reviewer string, created_at string, notes string, evidence array<string>"
ARTICLE = "id string, title string, slug string, track string, status string, body_markdown string, tags array<string>, item_ids array<string>, viewpoint_ids array<string>, created_at string, updated_at string"
VIEWPOINT = "id string, title string, tags array<string>, body string, source string, status string, related_item_ids array<string>, created_at string, updated_at string"
LINK = "id string, item_id string, ref string, ref_kind string, relation string, direction string, title string, created_at string"
ENTRY = "source_id string, pos int, title string, url string, guid string, author string, published_at date, summary string, tags array<string>"

# The states and decisions that the data use.
READER_STATUS = ("triaged", "researching", "drafting", "reviewing", "fact-checking", "ready", "published")
READER_ACTIONS = ("accepted-for-editing", "direct-pr-small-news", "revisit-with-personal-notes")
