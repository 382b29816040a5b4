"""Plan-level decisions (broadcast vs shuffle sizing) and plan inspection."""
