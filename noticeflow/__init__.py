"""noticeflow: notice tracking, text extraction and record linkage as Spark jobs."""
