"""Table schemas; none is inferred on read."""

from __future__ import annotations

RESPONSE = "assets array<string>, market_classification string, catalysts array<struct<category:string,event_timestamp:bigint,first_public_timestamp:bigint,direction:string,confidence:string,description:string,assets:array<string>,sources:array<struct<title:string,publisher:string,url:string,published_at:string>>>>"
DIGEST = "dominant_driver string, secondary_driver string, macro struct<lean:string>, tradfi struct<lean:string>"
GROUNDING = "webSearchQueries array<string>, groundingChunks array<struct<web:struct<uri:string,title:string>>>"
