"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

JSONLD_PAGE = (
    "workExample array<struct<name:string,datePublished:string,duration:string,description:string,"
    "offers:array<struct<url:string>>>>"
)
SEARCH_ITEM = "array<struct<title:string,url:string,snippet:string,description:string>>"
REGISTRY = (
    "episode_id string, podcast_id string, episode_title string, first_seen string, first_seen_week_id string, "
    "last_seen string, seen_count int, decision string, statuses array<string>"
)
QUEUE = (
    "selection_id string, run_id string, week_id string, episode_id string, podcast_id string, action string, "
    "selected_at string, status string, doc_id string, doc_url string, finished_at string"
)
