"""Named queries over the driver's tables and the SQL each is compared with."""
