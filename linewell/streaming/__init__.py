from linewell.streaming.source import follow
from linewell.streaming.jobs import (
    batch_status, current_epoch, epochs_of, follow_counts, follow_numbered, follow_search,
    follow_status, latest_lines, losses, number_batch,
)
from linewell.streaming.progress import progress_of, search_with_progress
from linewell.streaming.upsert import follow_upsert, upsert_batch, upserted, upserted_losses
from linewell.streaming.view import batch_view, follow_view, view_of

__all__ = [
    "batch_status", "batch_view", "current_epoch", "epochs_of", "follow", "follow_counts",
    "follow_numbered", "follow_search", "follow_status", "follow_upsert",
    "follow_view", "latest_lines", "losses", "number_batch",
    "progress_of", "search_with_progress", "upsert_batch", "upserted", "upserted_losses", "view_of",
]
