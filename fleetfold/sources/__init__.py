"""Where tables come from and go to: submissions, logs, waypoints, stored tables."""
