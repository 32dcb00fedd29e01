"""Plan builders: paging, search, SQL access, upserts."""
