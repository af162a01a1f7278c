"""Where samples come from and go to: tables, write requests, the sample store."""
