"""Where requests and tables come from: JSON, URL parameters, the catalog."""
